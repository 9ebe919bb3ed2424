"""Groups, ownership and what a user may see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscript.functions import paths
from twinscript.operators import catalog


def groups_of(groups: DataFrame, uid: str, requested: list[str] | None = None) -> DataFrame:
    """Groups the user is a member of, of those asked for."""
    mine = groups.where(F.array_contains("members", uid))
    if requested is not None:
        mine = mine.where(F.col("gid").isin(requested))
    return mine.select("gid").distinct()


def members(groups: DataFrame) -> DataFrame:
    return groups.select("gid", F.explode("members").alias("member"))


def group_counts(groups: DataFrame) -> DataFrame:
    """Groups per user."""
    return members(groups).groupBy("member").agg(F.array_sort(F.collect_set("gid")).alias("gids"))


def create_group(groups: DataFrame, gid: str, owner: str) -> DataFrame:
    """A new group with its owner as first member; an existing one is left as it is."""
    new = groups.sparkSession.range(1).select(
        F.lit(gid).alias("gid"), F.lit(owner).alias("owner"), F.array(F.lit(owner)).alias("members"))
    return groups.select("gid", "owner", "members").unionByName(new.join(groups.select("gid"), "gid", "left_anti"))


def add_member(groups: DataFrame, gid: str, uid: str) -> DataFrame:
    added = F.array_sort(F.array_union("members", F.array(F.lit(uid))))
    return groups.withColumn("members", F.when(F.col("gid") == gid, added).otherwise(F.col("members")))


def remove_member(groups: DataFrame, gid: str, uid: str) -> DataFrame:
    kept = F.array_remove("members", uid)
    return groups.withColumn("members", F.when(F.col("gid") == gid, kept).otherwise(F.col("members")))


def delete_group(groups: DataFrame, gid: str) -> DataFrame:
    return groups.where(F.col("gid") != gid)


def visible(records: DataFrame, groups: DataFrame, uid: str, requested: list[str] | None = None) -> DataFrame:
    """Records of the user's groups or owned by the user, in one pass over the records."""
    mine = groups_of(groups, uid, requested).select(F.col("gid").alias("_gid"))
    gid, owner = catalog.field(records, "gid"), catalog.field(records, "owner")
    return (records.join(mine, gid == F.col("_gid"), "left")
            .where(F.col("_gid").isNotNull() | owner.eqNullSafe(uid)).drop("_gid"))


def slots(branches: DataFrame, groups: DataFrame, uid: str) -> DataFrame:
    """Slots with at least one branch the user may read."""
    return visible(branches, groups, uid).select("slot").distinct()


def owner(records: DataFrame) -> DataFrame:
    """``path, owner``: the record's owner, its creator, its branch's owner, or the branch name."""
    roots = records.where(F.size(F.split("path", "/")) == 2).select(
        F.col("path").alias("_root"), F.col("meta")["owner"].alias("_branch_owner"))
    p = F.col("path")
    joined = records.withColumn("_root", paths.branch_root(p)).join(roots, "_root", "left")
    return joined.select("path", F.coalesce(
        F.col("meta")["owner"], F.col("meta")["creator"], F.col("_branch_owner"), paths.branch(p)).alias("owner"))


def may_write(records: DataFrame, uid: str) -> DataFrame:
    return owner(records).where(F.col("owner") == uid).select("path")


def set_group(records: DataFrame, branch: str, gid: str, uid: str) -> DataFrame:
    """Give a branch and its subtree to another group; only records of the owner change."""
    allowed = may_write(records.where(catalog.subtree(branch) | (F.size(F.split("path", "/")) == 2)), uid)
    change = F.create_map(F.lit("gid"), F.lit(gid))
    hit: Column = catalog.subtree(branch) & F.col("_ok").isNotNull()
    joined = records.join(allowed.withColumn("_ok", F.lit(True)), "path", "left")
    return joined.withColumn("meta", F.when(hit, catalog._overlay(F.col("meta"), change))
                             .otherwise(F.col("meta"))).drop("_ok")
