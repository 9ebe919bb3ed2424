"""The metadata catalog: records ``path`` + ``meta`` map, with known keys optionally as columns.

Reading operators are predicates, projections and aggregates over a DataFrame; writing operators
return the changed catalog, one equi-join per batch of changes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinscript.functions import paths
from twinscript.operators.numbering import with_neighbours

HISTORY_FLAG = "_METADATATYPE_"
# Condition prefixes, and the form of keys that are left out.
PREFIXES = ["ONE_OF_", "ALL_OF_", "STARTS_WITH_", "ENDS_WITH_", "INCLUDES_", "REGEX_", "MIN_", "MAX_", "NOT_"]
CORRUPT_KEY = r"(?i)^HASH\([0-9a-fx]+\)$"


def field(df: DataFrame, key: str) -> Column:
    """A key's value: the column of that name if there is one, else the map entry."""
    if key == "_ID_":
        return F.col("path")
    return F.col(f"`{key}`") if key in df.columns else F.col("meta")[key]


def record(entries: dict[str, Column]) -> Column:
    """A string map of the given values, without those that are null."""
    full = F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v.cast("string"))])
    return F.map_filter(full, lambda k, v: v.isNotNull())


def values(c: Column) -> Column:
    """A comma-joined value as an array without empty elements."""
    return F.filter(F.split(c.cast("string"), ","), lambda x: x != "")


def condition(df: DataFrame, key: str, value: str) -> Column:
    """One condition of the predicate language; a record without the key fails all but ``NOT_``."""
    prefix = next((p for p in PREFIXES if key.startswith(p)), "")
    c = field(df, key[len(prefix):])
    text = c.cast("string")
    listed = F.array(*[F.lit(v) for v in str(value).split(",") if v])
    test = {
        "": lambda: text == value,
        "NOT_": lambda: text.isNull() | (text != value),
        "ONE_OF_": lambda: F.arrays_overlap(values(c), listed),
        "ALL_OF_": lambda: F.size(F.array_except(listed, values(c))) == 0,
        "STARTS_WITH_": lambda: text.startswith(value),
        "ENDS_WITH_": lambda: text.endswith(value),
        "INCLUDES_": lambda: text.contains(value),
        "REGEX_": lambda: text.rlike(value),
        "MIN_": lambda: c.try_cast("double") >= float(value),
        "MAX_": lambda: c.try_cast("double") <= float(value),
    }[prefix]()
    return F.coalesce(test, F.lit(False))


def where(df: DataFrame, **conditions: str) -> DataFrame:
    """Records for which all conditions hold; pass keys with dashes through ``**{…}``."""
    return reduce(lambda acc, kv: acc.where(condition(df, *kv)), conditions.items(), df)


def under(df: DataFrame, path: str) -> DataFrame:
    """The subtree below ``path``, without the record itself and without sibling prefixes."""
    return df.where(F.col("path").startswith(path.rstrip("/") + "/"))


def current(df: DataFrame) -> DataFrame:
    """Without history records."""
    return df.where(~F.col("meta")[HISTORY_FLAG].eqNullSafe("history"))


def search(df: DataFrame, conditions: dict[str, str] | None = None, order: str | None = None,
           descending: bool = False, limit: int | None = None, skip: int = 0,
           full: bool = False) -> DataFrame:
    """Matching records, ids only or in full, ordered, with the first ``skip`` left out."""
    out = where(df, **(conditions or {}))
    if order:
        key = field(df, order)
        out = out.orderBy(key.desc() if descending else key, "path")
    elif limit is not None or skip:
        out = out.orderBy("path")
    if skip:
        out = out.offset(skip)
    if limit is not None:
        out = out.limit(limit)
    return out if full else out.select("path")


class Pages:
    """Records kept in order, so that a page reads only the ranges it lies in, however many records come before it.

    ``path`` gets the records in folders, one per range of the order, and ``sizes`` is a row per range.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, df: DataFrame, path: str, order: str | None = None, descending: bool = False) -> Pages:
        """Sort the records by a key and path once, and write them with their places."""
        ordered = df if order is None else df.withColumn("_key", field(df, order))
        keys = ["path"] if order is None else [F.col("_key").desc() if descending else F.col("_key"), "path"]
        placed = ordered.orderBy(*keys).drop("_key").withColumn("_id", F.monotonically_increasing_id())
        (placed.withColumn("_range", F.shiftright("_id", 33)).withColumn("_place", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id")
         .write.partitionBy("_range").parquet(f"{path}/rows"))
        pages = cls(df.sparkSession, path)
        rows = pages._rows()
        before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
        sizes.select("_range", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).coalesce(1).write.parquet(f"{path}/sizes")
        return pages

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def page(self, skip: int, limit: int) -> DataFrame:
        """Records ``skip`` to ``skip + limit`` in order, read from the ranges that hold them."""
        sizes = self.spark.read.parquet(f"{self.path}/sizes")
        held = sizes.where((F.col("before") < skip + limit) & (F.col("before") + F.col("n") > skip)).collect()  # as many rows as the page spans
        rows = self._rows().where(F.col("_range").isin([r["_range"] for r in held]))
        starts = F.create_map(*[F.lit(x) for r in held for x in (r["_range"], r["before"])]) if held else F.create_map().cast("map<int,bigint>")
        at = F.col("_place") + F.element_at(starts, F.col("_range").cast("int"))
        return rows.withColumn("_at", at).where(F.col("_at").between(skip, skip + limit - 1)).orderBy("_at").drop("_at", "_place", "_range")


def find(df: DataFrame, kind: str | None = None, below: str | None = None) -> DataFrame:
    """Resources of a type, optionally below a path."""
    out = under(df, below) if below else df
    return where(out, **{"resource-type": kind}) if kind else out


def aggregate(df: DataFrame, actions: str) -> DataFrame:
    """``SUM_a,MIN_b,MAX_c``: values, paths of extremes and number of records, in one pass.

    Records without a key do not count for it; of equal extremes the smallest path is given.
    """
    out = [F.count(F.lit(1)).alias("count")]
    for action in actions.split(","):
        op, key = action.split("_", 1)
        v = field(df, key).try_cast("double")
        if op == "SUM":
            out.append(F.sum(v).alias(action))
        else:
            sign = 1 if op == "MIN" else -1
            first = F.min(F.when(v.isNotNull(), F.struct((v * sign).alias("v"), F.col("path").alias("p"))))
            out += [(first["v"] * sign).alias(action), first["p"].alias(f"{action}_path")]
    return df.agg(*out)


def sizes(units: DataFrame, key: str) -> DataFrame:
    """Records per document."""
    return units.groupBy(key).agg(F.count(F.lit(1)).alias("size"))


def languages(df: DataFrame, by: tuple[str, ...] = ("slot", "branch"), lang: str = "lang") -> DataFrame:
    """The languages of each corpus, sorted."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_set(lang)).alias("languages"))


def language_pairs(pairs: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The language pairs of each corpus, sorted."""
    return pairs.groupBy(*by).agg(F.array_sort(F.collect_set(
        F.concat_ws("-", "src_lang", "trg_lang"))).alias("pairs"))


def language_matrix(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sizes per language (diagonal) and per language pair, with totals per row."""
    mono = docs.select(F.col("lang").alias("src"), F.col("lang").alias("trg"), "size")
    both = pairs.select(F.col("src_lang").alias("src"), F.col("trg_lang").alias("trg"),
                        F.least("src_size", "trg_size").alias("size"))
    return (mono.unionByName(both).cube("src", "trg").agg(F.sum("size").alias("size"))
            .where("src is not null or trg is null")
            .select(F.coalesce("src", F.lit("all")).alias("src"), F.coalesce("trg", F.lit("all")).alias("trg"), "size"))


def aligned(alignments: DataFrame) -> DataFrame:
    """Both directions of every recorded alignment."""
    back = alignments.select(F.col("trg_path").alias("src_path"), F.col("src_path").alias("trg_path"))
    return alignments.select("src_path", "trg_path").unionByName(back)


def audit(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Files without a catalog record."""
    return files.join(catalog.select("path"), "path", "left_anti")


def default_meta(files: DataFrame, size: str = "size") -> DataFrame:
    """The record a file below ``xml/`` gets when it has none, derived from its path."""
    lang = paths.language(F.col("path"))
    pair = lang.rlike("^..-..$")
    kind = F.when(pair, "sentalign").otherwise("corpusfile")
    known = record({
        "language": F.replace(lang, F.lit("-"), F.lit(",")),
        "source-language": F.when(pair, F.substring(lang, 1, 2)),
        "target-language": F.when(pair, F.substring(lang, 4, 2)),
        "resource-type": kind, "kind": kind, "status": F.lit("metadata repaired"), "size": F.col(size)})
    return (files.where((paths.base(F.col("path")) == "xml") & lang.rlike("^..(-..)?$") & F.col("path").endswith(".xml"))
            .select("path", known.alias("meta")))


# -- writes ---------------------------------------------------------------------------------

def _empty() -> Column:
    return F.create_map().cast("map<string,string>")


def _sound(meta: Column) -> Column:
    return F.map_filter(F.coalesce(meta, _empty()), lambda k, v: ~k.rlike(CORRUPT_KEY))


def _overlay(old: Column, new: Column) -> Column:
    """Entries of ``new`` over those of ``old``."""
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k))
    return F.map_concat(kept, new)


def merge_values(old: Column, new: Column) -> Column:
    """Union of two comma lists, sorted."""
    both = F.array_union(F.coalesce(values(old), F.array().cast("array<string>")), values(new))
    return F.array_join(F.array_sort(both), ",")


def remove_value(old: Column, value: Column) -> Column:
    """A comma list without one value."""
    return F.array_join(F.filter(values(old), lambda x: x != value), ",")


def _changed(catalog: DataFrame, updates: DataFrame, combine) -> DataFrame:
    """Catalog with ``combine(old, new)`` where an update exists; new records are added.

    ``updates`` has one row per path.  Records below branch level take their group from the
    branch record, whatever the update says.
    """
    u = updates.select("path", F.col("meta").alias("_new"))
    return _combined(catalog.select("path", "meta").join(u, "path", "full_outer"), catalog, combine)


def _combined(rows: DataFrame, catalog: DataFrame, combine) -> DataFrame:
    """``_changed`` for rows that hold a record's ``meta`` and, if it changes, ``_new`` side by side."""
    merged = (rows.withColumn("_old", F.coalesce("meta", _empty()))
              .withColumn("_sound", _sound(F.col("_new")))
              .withColumn("meta", F.when(F.col("_new").isNull(), F.col("_old")).otherwise(
                  combine(F.col("_old"), F.col("_sound")))))
    branches = catalog.where(F.size(F.split("path", "/")) == 2).select(
        F.col("path").alias("_root"), F.col("meta")["gid"].alias("_gid"))
    out = merged.withColumn("_root", paths.branch_root(F.col("path"))).join(branches, "_root", "left")
    inherit = F.col("_new").isNotNull() & F.col("_gid").isNotNull() & (F.size(F.split("path", "/")) > 2)
    gid = F.create_map(F.lit("gid"), F.col("_gid"))
    return out.select("path", F.when(inherit, _overlay(F.col("meta"), gid)).otherwise(F.col("meta")).alias("meta"))


def _added(old: Column, new: Column) -> Column:
    return _overlay(old, F.transform_values(new, lambda k, v: merge_values(F.element_at(old, k), v)))


def post(catalog: DataFrame, updates: DataFrame) -> DataFrame:
    """Overwrite the given keys."""
    return _changed(catalog, updates, _overlay)


def put(catalog: DataFrame, updates: DataFrame) -> DataFrame:
    """Add values to the given keys, keeping those that are there."""
    return _changed(catalog, updates, _added)


def delete(catalog: DataFrame, requests: DataFrame) -> DataFrame:
    """Delete records, keys or single values.

    ``requests(path, meta)``: a null map deletes the record, ``*`` or a null value deletes the
    key, and any other value is taken out of the key's list.
    """
    r = requests.select("path", F.col("meta").alias("_req"), F.lit(True).alias("_hit"))
    joined = catalog.join(r, "path", "left").where("_hit is null or _req is not null")
    req = F.coalesce("_req", _empty())
    whole = F.map_filter(req, lambda k, v: v.isNull() | (v == "*"))
    meta = F.map_filter(F.col("meta"), lambda k, v: ~F.map_contains_key(whole, k))
    meta = F.transform_values(meta, lambda k, v: F.when(
        F.map_contains_key(req, k), remove_value(v, F.element_at(req, k))).otherwise(v))
    return joined.withColumn("meta", meta).drop("_req", "_hit")


def subtree(path: str) -> Column:
    """The record at ``path`` and everything below; with a final slash only what is below."""
    below = F.col("path").startswith(path.rstrip("/") + "/")
    return below if path.endswith("/") else below | (F.col("path") == path)


def put_recursive(catalog: DataFrame, path: str, data: dict[str, str]) -> DataFrame:
    return _recursive(catalog, path, data, _added)


def post_recursive(catalog: DataFrame, path: str, data: dict[str, str]) -> DataFrame:
    return _recursive(catalog, path, data, _overlay)


def _recursive(catalog: DataFrame, path: str, data: dict[str, str], combine) -> DataFrame:
    """A whole subtree is changed where its records are read; they are not joined with themselves."""
    literal = F.create_map(*[F.lit(x) for kv in data.items() for x in kv])
    return _combined(catalog.select("path", "meta", F.when(subtree(path), literal).alias("_new")), catalog, combine)


def delete_recursive(catalog: DataFrame, path: str) -> DataFrame:
    return catalog.where(~subtree(path))


def copy(catalog: DataFrame, old: str, new: str, owner: str | None = None) -> DataFrame:
    """The catalog with all records whose path starts with ``old`` repeated under ``new``."""
    extra = {"status": "copied", **({"owner": owner} if owner is not None else {})}
    literal = F.create_map(*[F.lit(x) for kv in extra.items() for x in kv])
    moved = catalog.where(F.col("path").startswith(old)).select(
        F.concat(F.lit(new), F.substring(F.col("path"), F.lit(len(old) + 1), F.length("path"))).alias("path"),
        _overlay(F.col("meta"), literal).alias("meta"))
    return catalog.select("path", "meta").unionByName(moved)


def archive(catalog: DataFrame, paths_: DataFrame) -> DataFrame:
    """The catalog plus a history record ``path@revision`` for each ``(path, revision)``."""
    flag = F.create_map(F.lit(HISTORY_FLAG), F.lit("history"))
    old = (catalog.join(paths_, "path")
           .select(F.concat_ws("@", "path", F.col("revision").cast("string")).alias("path"),
                   _overlay(F.col("meta"), flag).alias("meta")))
    return catalog.select("path", "meta").unionByName(old)


def history(changes: DataFrame, key: str = "path", order: str = "revision") -> DataFrame:
    """Revisions in order with what each replaced; ``is_current`` marks the last one.

    A resource may have any number of revisions: they are sorted across tasks.
    """
    return with_neighbours(changes, [key], [order], "value", "previous", "is_current")


# Levels of parameters, weakest first.
LEVELS = ["default", "user", "corpus", "uploads", "resource"]


def effective_params(params: DataFrame, prefix: str, doc_type: str | None = None) -> DataFrame:
    """The value in force per resource and parameter: the strongest level wins.

    ``params(resource, level, key, value)``; at one level a key for the document type beats the
    general key.
    """
    level = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level"))
    mine = params.where(F.col("key").startswith(prefix)).withColumn(
        "param", F.substring(F.col("key"), F.lit(len(prefix) + 1), F.length("key")))
    special = F.lit(False)
    if doc_type is not None:
        special = F.col("param").startswith(doc_type + "_")
        mine = mine.withColumn("_special", special).withColumn("param", F.when(
            special, F.substring(F.col("param"), F.lit(len(doc_type) + 2), F.length("param"))).otherwise(F.col("param")))
    else:
        mine = mine.withColumn("_special", special)
    return mine.groupBy("resource", "param").agg(
        F.max_by("value", F.struct(level, F.col("_special"), F.col("value"))).alias("value"),
        F.max_by("level", F.struct(level, F.col("_special"), F.col("value"))).alias("level"))
