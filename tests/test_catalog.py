"""Catalog predicates and writes on a few records."""

import pytest
from pyspark.sql import functions as F

from twinscript.operators import acl, catalog


@pytest.fixture
def records(spark):
    rows = [
        ("s/b", {"gid": "g1", "owner": "ann"}), ("s/b/a", {"lang": "en,sv", "size": "9"}),
        ("s/b/a/x", {"lang": "en", "size": "12", "owner": "bob"}), ("s/b/ac", {"lang": "fi", "size": "many"}),
        ("s/b/a@3", {"lang": "en", catalog.HISTORY_FLAG: "history"}),
    ]
    return spark.createDataFrame(rows, "path string, meta map<string,string>")


def found(df):
    return {r["path"] for r in df.collect()}


def test_conditions(records):
    assert found(catalog.where(records, ONE_OF_lang="sv,fi")) == {"s/b/a", "s/b/ac"}
    assert found(catalog.where(records, ALL_OF_lang="sv,en")) == {"s/b/a"}
    assert found(catalog.where(records, MIN_size="10")) == {"s/b/a/x"}
    assert found(catalog.where(records, MAX_size="10")) == {"s/b/a"}
    assert found(catalog.where(records, NOT_lang="en")) == {"s/b", "s/b/a", "s/b/ac"}
    assert found(catalog.where(records, lang="en", REGEX__ID_="x$")) == {"s/b/a/x"}
    assert found(catalog.under(records, "s/b/a")) == {"s/b/a/x"}
    assert "s/b/a@3" not in found(catalog.current(records))


def test_aggregates_leave_out_what_is_no_number(records):
    row = catalog.aggregate(records, "SUM_size,MAX_size").first()
    assert (row["SUM_size"], row["MAX_size"], row["MAX_size_path"], row["count"]) == (21.0, 12.0, "s/b/a/x", 5)


def test_put_is_idempotent_and_inherits_the_group(records, spark):
    update = spark.createDataFrame([("s/b/a", {"lang": "fi,en", "HASH(0x1f)": "x"}), ("s/b/new", {"lang": "de"})],
                                   "path string, meta map<string,string>")
    once = catalog.put(records, update)
    meta = {r["path"]: r["meta"] for r in once.collect()}
    assert meta["s/b/a"] == {"lang": "en,fi,sv", "size": "9", "gid": "g1"}
    assert meta["s/b/new"] == {"lang": "de", "gid": "g1"}
    assert {r["path"]: r["meta"] for r in catalog.put(once, update).collect()} == meta


def test_delete_value_key_and_record(records, spark):
    req = spark.createDataFrame([("s/b/a", {"lang": "sv", "size": "*"}), ("s/b/ac", None)], "path string, meta map<string,string>")
    meta = {r["path"]: r["meta"] for r in catalog.delete(records, req).collect()}
    assert meta["s/b/a"] == {"lang": "en"} and "s/b/ac" not in meta and len(meta) == 4


def test_subtree_writes_spare_siblings(records):
    meta = {r["path"]: r["meta"].get("status") for r in catalog.post_recursive(records, "s/b/a", {"status": "x"}).collect()}
    assert meta == {"s/b": None, "s/b/a": "x", "s/b/a/x": "x", "s/b/ac": None, "s/b/a@3": None}
    assert found(catalog.delete_recursive(records, "s/b/a/")) == {"s/b", "s/b/a", "s/b/ac", "s/b/a@3"}


def test_owners_and_visibility(records, spark):
    owners = {r["path"]: r["owner"] for r in acl.owner(records).collect()}
    assert owners["s/b/a/x"] == "bob" and owners["s/b/a"] == "ann"
    groups = spark.createDataFrame([("g1", "ann", ["ann", "eve"])], "gid string, owner string, members array<string>")
    flat = records.select("path", F.col("meta"))
    assert found(acl.visible(flat, groups, "eve")) == {"s/b"}
    assert found(acl.visible(flat, groups, "bob")) == {"s/b/a/x"}
    assert found(acl.visible(flat, groups, "eve", ["g2"])) == set()


def test_parameters_of_the_strongest_level_win(spark):
    rows = [("r", "default", "P_x", "1"), ("r", "user", "P_x", "2"), ("r", "corpus", "P_pdf_x", "3"), ("r", "corpus", "P_x", "4")]
    df = spark.createDataFrame(rows, "resource string, level string, key string, value string")
    assert catalog.effective_params(df, "P_", "pdf").first()["value"] == "3"
    plain = {r["param"]: r["value"] for r in catalog.effective_params(df, "P_").collect()}
    assert plain == {"x": "4", "pdf_x": "3"}
