"""Numbers and neighbours across sort chunks, with one group that fills most of them."""

import pytest
from pyspark.sql import functions as F

from twinscript.operators import bitext, catalog
from twinscript.operators.numbering import CHUNK, number_rows, plain, renumber, with_neighbours


@pytest.fixture
def chunked(spark):
    """Small data in as many chunks as there are shuffle tasks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def rows(spark, n=2000):
    group = F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 41).cast("string")))
    return spark.range(n).select(group.alias("g"), (F.col("id") * 7919 % 10007).alias("k"), "id")


def test_numbers_of_a_hot_group_are_consecutive(chunked):
    out = number_rows(rows(chunked), ["k"], ["g"]).collect()
    assert len({r[CHUNK] for r in out}) > 2
    assert len({r[CHUNK] for r in out if r["g"] == "hot"}) > 1
    by_group = {}
    for r in out:
        by_group.setdefault(r["g"], []).append((r["k"], r["row_no"]))
    for pairs in by_group.values():
        assert [no for _, no in sorted(pairs)] == list(range(1, len(pairs) + 1))


def test_global_numbers_and_renumbering(chunked):
    numbered = number_rows(rows(chunked), ["k"])
    got = [(r["k"], r["row_no"]) for r in numbered.collect()]
    assert [no for _, no in sorted(got)] == list(range(1, 2001))
    odd = renumber(numbered.where("id % 2 = 1").drop("row_no"))
    got = [(r["k"], r["row_no"]) for r in odd.collect()]
    assert [no for _, no in sorted(got)] == list(range(1, 1001))
    assert CHUNK not in plain(odd).columns


def test_neighbours_cross_chunks(chunked):
    got = with_neighbours(rows(chunked), ["g"], ["k"], "id").collect()
    by_group = {}
    for r in got:
        by_group.setdefault(r["g"], []).append(r)
    for group in by_group.values():
        group.sort(key=lambda r: r["k"])
        assert [r["previous"] for r in group] == [None] + [r["id"] for r in group[:-1]]
        assert [r["is_last"] for r in group] == [False] * (len(group) - 1) + [True]


def test_history_marks_the_current_revision(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "path string, revision int, value string")
    got = {(r["path"], r["revision"]): (r["previous"], r["is_current"]) for r in catalog.history(df).collect()}
    assert got == {("a", 1): (None, False), ("a", 2): ("x", True), ("b", 1): (None, True)}


def test_splits_are_disjoint_and_complete(chunked):
    df = chunked.range(500).select("id", F.lit("s").alias("src_text"), F.lit("t").alias("trg_text"))
    parts = {"tune": (0, 50), "eval": (50, 50), "train": (100, None)}
    out = bitext.splits(df, ["id"], parts)
    assert {r["part"]: r["n"] for r in out.groupBy("part").agg(F.count("id").alias("n")).collect()} == {
        "tune": 50, "eval": 50, "train": 400}
    assert bitext.overlap(out, ["id"]).count() == 0


def test_sample_skips_records_read_and_counts_records_written(chunked):
    blank = F.when(F.col("id") % 4 == 0, " ").otherwise("x")
    df = chunked.range(100).select("id", blank.alias("src_text"), F.lit("t").alias("trg_text"))
    got = sorted(r["id"] for r in bitext.sample(df, ["id"], skip=10, size=5).collect())
    assert got == [10, 11, 13, 14, 15]
