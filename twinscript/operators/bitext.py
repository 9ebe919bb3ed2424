"""Bilingual text from links and sentences: assembly, cleaning, distinct units, ordered samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscript.operators.numbering import number_rows, plain, renumber


def link_type(links: DataFrame, kind: str) -> DataFrame:
    """Links of one type such as ``1:1``."""
    src, trg = (int(x) for x in kind.split(":"))
    return links.where((F.size("src_ids") == src) & (F.size("trg_ids") == trg))


def assemble(links: DataFrame, pairs: DataFrame, sentences: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Texts of both sides of each link; ids without a sentence are left out, a side without any is empty.

    Both sides go through one join on ``(doc, sentence)``, whose key is unique, so a large
    document spreads over many tasks; a link's few sentences are then put together.  Links that
    carry ``src_doc`` and ``trg_doc`` are not joined with their pairs again.  ``keep`` names
    columns of the links or pairs to pass on.
    """
    lacking = [c for c in ("src_doc", "trg_doc", *keep) if c not in links.columns]
    l = links.join(pairs.select("pair_id", *lacking), "pair_id") if lacking else links
    def side(name: str) -> Column:
        return F.struct(F.lit(name).alias("side"), F.col(f"{name}_doc").alias("doc"),
                        F.col(f"{name}_ids").cast("array<bigint>").alias("ids"))
    sides = l.select("pair_id", "link_pos", *keep, F.explode(F.array(side("src"), side("trg"))).alias("x"))
    ids = sides.select("pair_id", "link_pos", *keep, "x.side", "x.doc", F.posexplode_outer("x.ids").alias("n", "sent_pos"))
    s = sentences.select(F.col("doc_id").alias("doc"), "sent_pos", "text")
    def text(name: str) -> Column:
        mine = F.collect_list(F.when((F.col("side") == name) & F.col("text").isNotNull(), F.struct("n", "text")))
        return F.array_join(F.transform(F.array_sort(mine), lambda x: x["text"]), " ")
    return ids.join(s, ["doc", "sent_pos"], "left").groupBy("pair_id", "link_pos").agg(
        text("src").alias("src_text"), text("trg").alias("trg_text"), *[F.first(c).alias(c) for c in keep])


def is_clean(max_length: int | None = None, src: str = "src_text", trg: str = "trg_text") -> Column:
    """Both sides present, not blank, and not longer than allowed."""
    ok = (F.trim(src) != "") & (F.trim(trg) != "")
    if max_length is not None:
        ok = ok & (F.length(src) <= max_length) & (F.length(trg) <= max_length)
    return F.coalesce(ok, F.lit(False))


def clean(bitext: DataFrame, max_length: int | None = None) -> DataFrame:
    return bitext.where(is_clean(max_length))


def unique(bitext: DataFrame) -> DataFrame:
    """Distinct translation units with how often each occurred.

    Copies are merged before the shuffle, so a unit that makes up a third of all rows arrives
    as one row per task.
    """
    return bitext.groupBy("src_text", "trg_text").agg(F.count(F.lit(1)).alias("n"))


def sample(bitext: DataFrame, order: list[str], skip: int = 0, size: int | None = None,
           max_length: int | None = None) -> DataFrame:
    """Skip n records read, then stop after m records written; unusable records are read only."""
    read = number_rows(bitext, order).where(F.col("row_no") > skip)
    written = renumber(read.where(is_clean(max_length)).drop("row_no"))
    if size is not None:
        written = written.where(F.col("row_no") <= size)
    return plain(written)


def splits(bitext: DataFrame, order: list[str], parts: dict[str, tuple[int, int | None]]) -> DataFrame:
    """Disjoint parts by position: ``name → (skip, size)`` on one numbering of the usable records."""
    numbered = plain(number_rows(bitext.where(is_clean()), order))
    no = F.col("row_no")
    conds = []
    for name, (skip, size) in parts.items():
        inside = no > skip if size is None else (no > skip) & (no <= skip + size)
        conds.append((name, inside))
    label = reduce(lambda acc, c: F.when(c[1], c[0]) if acc is None else acc.when(c[1], c[0]), conds, None)
    return numbered.withColumn("part", label).where(F.col("part").isNotNull())


def overlap(parts: DataFrame, key: list[str]) -> DataFrame:
    """Records that ended up in more than one part; empty when the parts are disjoint."""
    return parts.groupBy(*key).agg(F.count_distinct("part").alias("parts")).where("parts > 1")


def union(corpora: dict[str, DataFrame]) -> DataFrame:
    """Several corpora as one stream of records, each marked with its corpus."""
    marked = [df.withColumn("corpus", F.lit(name)) for name, df in sorted(corpora.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)
