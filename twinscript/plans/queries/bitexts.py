"""Bitext assembly, cleaning, distinct units and ordered parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinscript.operators import align, bitext, ingest
from twinscript.plans import jobs
from twinscript.plans import sqltables as S
from twinscript.plans.queries.aligning import LADDER, ONE_TO_ONE, _rungs
from twinscript.plans.registry import query


@query("assemble_bitext", S.with_tables(LADDER, S.LINES, r"""
docs AS (SELECT pair_id, src_doc, trg_doc FROM doc_pairs),
parts AS (
  SELECT l.pair_id, link_pos, 'src' AS side, unnest(src_ids) AS id, src_doc AS doc FROM ladder l JOIN docs USING (pair_id)
  UNION ALL SELECT l.pair_id, link_pos, 'trg', unnest(trg_ids), trg_doc FROM ladder l JOIN docs USING (pair_id)),
texts AS (SELECT p.*, n.text FROM parts p JOIN lines n ON n.doc_id = p.doc AND n.sent_pos = p.id)""", select="""
SELECT pair_id, link_pos, md5(coalesce(string_agg(text, ' ' ORDER BY id) FILTER (side = 'src'), '')) AS src_md5,
       md5(coalesce(string_agg(text, ' ' ORDER BY id) FILTER (side = 'trg'), '')) AS trg_md5
FROM texts GROUP BY pair_id, link_pos"""))
def _(t):
    out = bitext.assemble(align.ladder_to_links(_rungs(t)), t.doc_pairs, t.sentences)
    return out.select("pair_id", "link_pos", F.md5("src_text").alias("src_md5"), F.md5("trg_text").alias("trg_md5"))


@query("links_of_type", S.with_tables(LADDER, select="""
SELECT pair_id, link_pos FROM ladder WHERE len(src_ids) = 2 AND len(trg_ids) = 2"""))
def _(t):
    return bitext.link_type(align.ladder_to_links(_rungs(t)), "2:2").select("pair_id", "link_pos")


@query("clean_bitext", S.with_tables(S.BITEXT, select="""
SELECT pair_id, length(src_text) AS src_len, length(trg_text) AS trg_len FROM bitext
WHERE trim(src_text) <> '' AND trim(trg_text) <> '' AND length(src_text) <= 400 AND length(trg_text) <= 400""").replace(
    "length(src_text) AS", "CAST(length(src_text) AS INTEGER) AS").replace("length(trg_text) AS", "CAST(length(trg_text) AS INTEGER) AS"))
def _(t):
    return bitext.clean(t.bitext, 400).select("pair_id", F.length("src_text").alias("src_len"), F.length("trg_text").alias("trg_len"))


@query("distinct_units", S.with_tables(S.BITEXT, select="""
SELECT md5(src_text) AS src_md5, md5(trg_text) AS trg_md5, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT src_text, trg_text FROM bitext UNION ALL SELECT src_text, trg_text FROM bitext WHERE conv_id % 2 = 0)
GROUP BY src_text, trg_text"""))
def _(t):
    twice = t.bitext.unionByName(t.bitext.where("conv_id % 2 = 0"))
    return bitext.unique(twice).select(F.md5("src_text").alias("src_md5"), F.md5("trg_text").alias("trg_md5"), "n")


@query("distinct_documents", """
SELECT md5(text) AS md5, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first_doc FROM documents GROUP BY md5(text)""")
def _(t):
    return t.documents.groupBy(F.md5("text").alias("md5")).agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


ORDERED = S.BITEXT + r""",
ordered AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS rn FROM bitext)"""


@query("sample_skip_and_size", S.with_tables(ORDERED, r"""
usable AS (SELECT *, row_number() OVER (ORDER BY rn) AS row_no FROM ordered
  WHERE rn > 20 AND length(src_text) <= 500 AND length(trg_text) <= 500)""", select="""
SELECT pair_id, row_no FROM usable WHERE row_no <= 60"""))
def _(t):
    return bitext.sample(t.bitext, ["conv_id", "turn"], skip=20, size=60, max_length=500).select("pair_id", "row_no")


PARTS = {"tune": (0, 50), "eval": (50, 50), "train": (100, None)}


@query("train_tune_eval_parts", S.with_tables(ORDERED, select="""
SELECT pair_id, rn AS row_no, CASE WHEN rn <= 50 THEN 'tune' WHEN rn <= 100 THEN 'eval' ELSE 'train' END AS part FROM ordered"""))
def _(t):
    return bitext.splits(t.bitext, ["conv_id", "turn"], PARTS).select("pair_id", "row_no", "part")


@query("parts_overlap", "SELECT 'x' AS pair_id, CAST(0 AS BIGINT) AS parts WHERE FALSE")
def _(t):
    return bitext.overlap(bitext.splits(t.bitext, ["conv_id", "turn"], PARTS), ["pair_id"])


@query("fetch_training_parts", S.with_tables(ONE_TO_ONE, S.LINES, r"""
texts AS (SELECT s.pair_id, s.link_pos, a.text AS src_text, b.text AS trg_text FROM steps s
  JOIN lines a ON a.doc_id = s.src_doc AND a.sent_pos = s.link_pos
  JOIN lines b ON b.doc_id = s.trg_doc AND b.sent_pos = s.link_pos),
usable AS (SELECT *, row_number() OVER (ORDER BY pair_id, link_pos) AS rn FROM texts)""", select="""
SELECT pair_id, CAST(link_pos AS INTEGER) AS link_pos, rn AS row_no,
       CASE WHEN rn <= 50 THEN 'tune' WHEN rn <= 100 THEN 'eval' ELSE 'train' END AS part FROM usable"""))
def _(t):
    out = jobs.fetch(align.one_to_one(t.doc_pairs, keep=("src_doc", "trg_doc")), t.doc_pairs, t.sentences, "1:1", PARTS)
    return out.select("pair_id", "link_pos", "row_no", "part")


@query("chunk_files", S.with_tables(S.RESOURCES, select="""
SELECT path, (row_number() OVER (ORDER BY path) - 1) // 300 AS chunk FROM resources"""))
def _(t):
    return ingest.chunk(t.resources.select("path"), 300)


@query("order_files", S.with_tables(S.RESOURCES, select="""
SELECT path, row_number() OVER (ORDER BY path) AS row_no FROM resources"""))
def _(t):
    from twinscript.operators.numbering import number_rows, plain
    return plain(number_rows(t.resources.select("path"), ["path"]))
