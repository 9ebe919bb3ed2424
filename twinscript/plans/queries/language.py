"""Language models, identification and what follows from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinscript.operators import align, langid
from twinscript.plans import sqltables as S
from twinscript.plans.queries.aligning import ONE_TO_ONE
from twinscript.plans.registry import query


def grams_sql(source: str, keys: str, name: str = "grams") -> str:
    """``keys, ngram, n`` of the texts of a table."""
    return rf"""
{name}_words AS (SELECT {keys}, word, count(*) AS w FROM (
    SELECT {keys}, unnest(string_split_regex(text, '[0-9\s]+')) AS word FROM {source}) WHERE word <> '' GROUP BY ALL),
{name}_cut AS (SELECT {keys}, w, unnest(flatten(list_transform(range(1, least(length(word) + 2, 5) + 1), lambda k:
    list_transform(range(1, length(word) + 4 - k), lambda i: substring('_' || word || '_', i, k))))) AS ngram FROM {name}_words),
{name} AS (SELECT {keys}, ngram, CAST(sum(w) AS BIGINT) AS n FROM {name}_cut GROUP BY ALL)"""


MODELS = grams_sql("documents", "lang", "known") + r""",
models AS (SELECT * FROM (SELECT lang, ngram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, ngram) AS rank FROM known)
  WHERE rank <= 400)"""


def distance_sql(keys: str) -> str:
    return rf"""
ranked AS (SELECT * FROM (SELECT {keys}, ngram, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, ngram) AS r FROM grams)
  WHERE r <= 400),
dist AS (SELECT {', '.join('t.' + k.strip() for k in keys.split(','))}, l.lang AS model,
    CAST(sum(CASE WHEN m.rank IS NULL THEN 400 ELSE abs(t.r - m.rank) END) AS BIGINT) AS distance, count(m.rank) AS hits
  FROM ranked t CROSS JOIN (SELECT DISTINCT lang FROM models) l
  LEFT JOIN models m ON m.lang = l.lang AND m.ngram = t.ngram GROUP BY ALL),
near AS (SELECT * FROM (SELECT *, min(distance) OVER (PARTITION BY {keys}) AS best FROM dist WHERE hits > 0)
  WHERE distance < 1.05 * best OR distance = best),
found AS (SELECT {keys}, array_to_string(list(model ORDER BY distance, model), ',') AS candidates FROM near GROUP BY ALL)"""


@query("character_ngrams", "WITH " + grams_sql("documents", "lang") + "SELECT lang, ngram, n FROM grams")
def _(t):
    return langid.ngrams(t.documents, ["lang"])


@query("language_models", "WITH " + MODELS + "SELECT lang, ngram, CAST(rank AS INTEGER) AS rank FROM models")
def _(t):
    return langid.train(t.documents)


@query("language_distances", "WITH " + MODELS + "," + grams_sql("documents", "doc_id") + "," + distance_sql("doc_id") +
       "SELECT doc_id, model, distance FROM dist WHERE hits > 0")
def _(t):
    return langid.distances(t.documents, ["doc_id"], langid.train(t.documents))


@query("identify_language", "WITH " + MODELS + "," + grams_sql("documents", "doc_id") + "," + distance_sql("doc_id") +
       """SELECT d.doc_id, coalesce(candidates, 'unknown') AS candidates, coalesce(string_split(candidates, ',')[1], 'unknown') AS detected
FROM documents d LEFT JOIN found f USING (doc_id)""")
def _(t):
    return langid.classify(t.documents, ["doc_id"], langid.train(t.documents)).select(
        "doc_id", F.array_join("candidates", ",").alias("candidates"), "detected")


@query("resolve_document_language", "WITH " + MODELS + "," + grams_sql("documents", "doc_id") + "," + distance_sql("doc_id") + """
SELECT d.doc_id, CASE WHEN list_contains(string_split(candidates, ','), d.declared) THEN d.declared
  ELSE coalesce(string_split(candidates, ',')[1], d.declared, 'xx') END AS language
FROM found f RIGHT JOIN (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'es' ELSE lang END AS declared FROM documents) d USING (doc_id)""")
def _(t):
    found = langid.classify(t.documents, ["doc_id"], langid.train(t.documents))
    declared = F.when(F.col("doc_id") % 3 == 0, "es").otherwise(F.col("lang"))
    named = found.join(t.documents.select("doc_id", declared.alias("lang")), "doc_id")
    return langid.resolve(named).select("doc_id", "language")


@query("sentence_language_flags", "WITH " + MODELS + "," + S.LINES + "," + grams_sql("lines", "doc_id, sent_pos") + "," +
       distance_sql("doc_id, sent_pos") + """
SELECT l.doc_id, l.sent_pos, l.lang, coalesce(string_split(candidates, ',')[1], 'unknown') AS detected,
       round(coalesce(c.confidence, 0), 9) AS confidence
FROM lines l LEFT JOIN found f ON l.doc_id = f.doc_id AND l.sent_pos = f.sent_pos
LEFT JOIN (SELECT doc_id, sent_pos, CASE WHEN len(ds) = 1 THEN 1.0::DOUBLE WHEN ds[2] > 0 THEN 1 - ds[1] / ds[2] ELSE 0 END AS confidence
  FROM (SELECT doc_id, sent_pos, list(distance ORDER BY distance) AS ds FROM dist WHERE hits > 0 GROUP BY ALL)) c
  ON l.doc_id = c.doc_id AND l.sent_pos = c.sent_pos
WHERE coalesce(string_split(candidates, ',')[1], 'unknown') <> l.lang""")
def _(t):
    return langid.flags(t.sentences, ["doc_id", "sent_pos"], langid.train(t.documents)).withColumn("confidence", F.round("confidence", 9))


@query("flag_and_filter_links", S.with_tables(ONE_TO_ONE, MODELS, S.LINES, grams_sql("lines", "doc_id, sent_pos"), distance_sql("doc_id, sent_pos"), r"""
flags AS (SELECT l.doc_id, l.sent_pos, coalesce(string_split(candidates, ',')[1], 'unknown') AS detected
  FROM lines l LEFT JOIN found f ON l.doc_id = f.doc_id AND l.sent_pos = f.sent_pos
  WHERE coalesce(string_split(candidates, ',')[1], 'unknown') <> l.lang),
seen AS (SELECT s.pair_id, s.link_pos, (s.link_pos <= s.src_size)::INT + (s.link_pos <= s.trg_size)::INT AS n,
    coalesce((a.detected = 'unknown')::INT, 0) + coalesce((b.detected = 'unknown')::INT, 0) AS un,
    coalesce((a.detected <> 'unknown')::INT, 0) + coalesce((b.detected <> 'unknown')::INT, 0) AS other FROM steps s
  LEFT JOIN flags a ON a.doc_id = s.src_doc AND a.sent_pos = s.link_pos LEFT JOIN flags b ON b.doc_id = s.trg_doc AND b.sent_pos = s.link_pos)""",
       select="SELECT pair_id, CAST(link_pos AS INTEGER) AS link_pos FROM seen WHERE other = 0 AND un < n"))
def _(t):
    """Links whose sentences are found to be in the languages of their documents."""
    flagged = langid.flags(t.sentences, ["doc_id", "sent_pos"], langid.train(t.documents))
    return align.filter_lang(align.one_to_one(t.doc_pairs), langid.link_flags(flagged, t.doc_pairs)).select("pair_id", "link_pos")


@query("language_sample", """
SELECT doc_id, CAST(length(s) AS INTEGER) AS n, md5(s) AS md5
FROM (SELECT doc_id, substring(text, length(text) // 10 + 1, length(text) - 2 * (length(text) // 10)) AS s FROM documents)""")
def _(t):
    s = langid.sample_text(F.col("text"), F.floor(F.length("text") / 10).cast("int"))
    return t.documents.select("doc_id", F.length(s).alias("n"), F.md5(s).alias("md5"))


@query("identification_confusion", "WITH " + MODELS + "," + grams_sql("documents", "doc_id") + "," + distance_sql("doc_id") + """
SELECT d.lang, coalesce(string_split(candidates, ',')[1], 'unknown') AS detected, CAST(count(*) AS BIGINT) AS n
FROM documents d LEFT JOIN found f USING (doc_id) GROUP BY ALL""")
def _(t):
    found = langid.detect("ngrams", t.documents, ["doc_id"], langid.train(t.documents))
    return found.join(t.documents.select("doc_id", "lang"), "doc_id").groupBy("lang", "detected").agg(
        F.count(F.lit(1)).alias("n"))
