"""Sentence alignment and link statistics over the derived document pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinscript.functions import scores
from twinscript.functions import text as X
from twinscript.operators import align, bitext
from twinscript.plans import jobs
from twinscript.plans import sqltables as S
from twinscript.plans.registry import query


def line_arrays(t):
    """Line lengths of each document from its own row."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return align.length_arrays(t.documents, lines)


def line_pairs(t):
    return align.with_lengths(t.doc_pairs, line_arrays(t))


ONE_TO_ONE = S.PAIRS + r""",
steps AS (SELECT pair_id, src_doc, trg_doc, src_lang, trg_lang, src_size, trg_size,
  unnest(range(1, greatest(src_size, trg_size) + 1)) AS link_pos FROM doc_pairs)"""


@query("aligned_line_statistics", S.with_tables(ONE_TO_ONE, S.LINES, r"""
texts AS (SELECT s.pair_id, s.src_lang, s.trg_lang, a.text AS src_text, b.text AS trg_text FROM steps s
  JOIN lines a ON a.doc_id = s.src_doc AND a.sent_pos = s.link_pos
  JOIN lines b ON b.doc_id = s.trg_doc AND b.sent_pos = s.link_pos)""", select="""
SELECT src_lang, trg_lang, CAST(count(*) AS BIGINT) AS links, CAST(count(DISTINCT pair_id) AS BIGINT) AS pairs,
       CAST(sum(length(src_text)) AS BIGINT) AS src_chars, CAST(sum(length(trg_text)) AS BIGINT) AS trg_chars
FROM texts GROUP BY src_lang, trg_lang"""))
def _(t):
    """Flagship: pair documents, link lines one to one, assemble the bitext, clean it, count."""
    known = ("src_doc", "trg_doc", "src_lang", "trg_lang")
    links = bitext.link_type(align.one_to_one(t.doc_pairs, keep=known), "1:1")
    named = bitext.clean(bitext.assemble(links, t.doc_pairs, t.sentences, keep=known[2:]))
    per_pair = named.groupBy("src_lang", "trg_lang", "pair_id").agg(
        F.count(F.lit(1)).alias("links"), F.sum(F.length("src_text")).alias("src_chars"),
        F.sum(F.length("trg_text")).alias("trg_chars"))
    return per_pair.groupBy("src_lang", "trg_lang").agg(
        F.sum("links").alias("links"), F.count(F.lit(1)).alias("pairs"),
        F.sum("src_chars").alias("src_chars"), F.sum("trg_chars").alias("trg_chars"))


@query("align_one_to_one", S.with_tables(ONE_TO_ONE, select="""
SELECT pair_id, CAST(link_pos AS INTEGER) AS link_pos, CAST(CASE WHEN link_pos <= src_size THEN link_pos END AS INTEGER) AS src,
       CAST(CASE WHEN link_pos <= trg_size THEN link_pos END AS INTEGER) AS trg FROM steps"""))
def _(t):
    return align.one_to_one(t.doc_pairs).select(
        "pair_id", "link_pos", F.get("src_ids", F.lit(0)).alias("src"), F.get("trg_ids", F.lit(0)).alias("trg"))


@query("link_types", S.with_tables(ONE_TO_ONE, select="""
SELECT pair_id, CASE WHEN link_pos > src_size THEN '0:1' WHEN link_pos > trg_size THEN '1:0' ELSE '1:1' END AS link_type,
       CAST(count(*) AS BIGINT) AS n FROM steps GROUP BY ALL"""))
def _(t):
    return align.type_histogram(align.one_to_one(t.doc_pairs))


@query("length_costs", S.with_tables(S.PAIRS, r"""
lens AS (SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: length(x)) AS ls
  FROM documents),
both_lens AS (SELECT d.pair_id, a.ls AS xs, b.ls AS ys, unnest(range(1, least(len(a.ls), len(b.ls)) + 1)) AS sent_pos
  FROM doc_pairs d JOIN lens a ON a.doc_id = d.src_doc JOIN lens b ON b.doc_id = d.trg_doc),
l AS (SELECT pair_id, sent_pos, xs[sent_pos]::DOUBLE AS x, ys[sent_pos]::DOUBLE AS y FROM both_lens),
z AS (SELECT *, abs(x - y) / sqrt(6.8 * (x + y) / 2) AS z FROM l),
u AS (SELECT *, 1 / (1 + 0.2316419::DOUBLE * z) AS t FROM z),
p AS (SELECT *, 2 * (1 - (1 - 0.3989423::DOUBLE * exp(-z * z / 2) * ((((1.330274429::DOUBLE * t - 1.821255978::DOUBLE) * t
  + 1.781477937::DOUBLE) * t - 0.356563782::DOUBLE) * t + 0.319381530::DOUBLE) * t)) AS tail FROM u)""", select="""
SELECT pair_id, sent_pos, round(CASE WHEN tail > 1e-9 THEN -ln(tail) ELSE 25 END, 4) AS cost FROM p"""))
def _(t):
    """Cost of every 1:1 line link; tails below 1e-9 are shown as the ceiling, where doubles agree."""
    pairs = line_pairs(t)
    both = pairs.select("pair_id", F.posexplode(F.slice(F.arrays_zip("src_lens", "trg_lens"), 1, F.least(
        F.size("src_lens"), F.size("trg_lens")))).alias("p", "l"))
    cost = scores.length_cost(F.col("l.src_lens").cast("double"), F.col("l.trg_lens").cast("double"))
    shown = F.when(cost < 20.7232, cost).otherwise(scores.MAX_COST)
    return both.select("pair_id", (F.col("p") + 1).cast("bigint").alias("sent_pos"), F.round(shown, 4).alias("cost"))


@query("align_by_length")
def _(t):
    return align.run(line_pairs(t), "length").select(
        "pair_id", "link_pos", F.array_join("src_ids", " ").alias("src_ids"), F.array_join("trg_ids", " ").alias("trg_ids"),
        F.round("score", 6).alias("score"))


@query("align_covers_every_line_once", S.with_tables(S.PAIRS, select="""
SELECT pair_id, src_size AS src_lines, trg_size AS trg_lines, src_size * (src_size + 1) // 2 AS src_sum,
       trg_size * (trg_size + 1) // 2 AS trg_sum FROM doc_pairs WHERE src_size + trg_size > 0"""))
def _(t):
    """Ids linked by the length aligner: how many, and their sum, which is that of 1…n."""
    links = align.length_based(line_pairs(t))
    def total(c):
        return F.sum(F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x))
    return links.groupBy("pair_id").agg(
        F.sum(F.size("src_ids")).alias("src_lines"), F.sum(F.size("trg_ids")).alias("trg_lines"),
        total("src_ids").alias("src_sum"), total("trg_ids").alias("trg_sum"))


align.register_missing("no-such-tool")


@query("align_unknown_method_falls_back")
def _(t):
    return align.stats(align.run(line_pairs(t), "no-such-tool")).select(
        "pair_id", "links", "src_sents", "trg_sents", F.round("cost", 6).alias("cost"))


# rungs: each 1:1 step of a pair, every third one left out, scored by its position
RUNGS = ONE_TO_ONE + r""",
rungs AS (SELECT pair_id, least(link_pos, src_size) AS src_end, least(link_pos, trg_size) AS trg_end,
  max(CAST(link_pos % 11 AS DOUBLE) - 12 + 4 * (link_pos % 4)) AS score FROM steps WHERE link_pos % 3 <> 0 GROUP BY ALL)"""


def _rungs(t):
    p = F.col("link_pos")
    s = t.doc_pairs.select("pair_id", "src_size", "trg_size", F.explode(F.sequence(
        F.lit(1).cast("bigint"), F.greatest("src_size", "trg_size"))).alias("link_pos")).where(p % 3 != 0)
    return s.groupBy("pair_id", F.least(p, F.col("src_size")).alias("src_end"), F.least(p, F.col("trg_size")).alias("trg_end")).agg(
        F.max((p % 11).cast("double") - 12 + 4 * (p % 4)).alias("score"))


LADDER = RUNGS + r""",
spans AS (SELECT pair_id, src_end, trg_end, row_number() OVER w AS link_pos, lag(src_end, 1, 0) OVER w AS s0,
  lag(trg_end, 1, 0) OVER w AS t0, lag(score, 1, 0.0) OVER w AS score
  FROM rungs WINDOW w AS (PARTITION BY pair_id ORDER BY src_end, trg_end)),
ladder AS (SELECT pair_id, CAST(link_pos AS INTEGER) AS link_pos, range(s0 + 1, src_end + 1) AS src_ids, range(t0 + 1, trg_end + 1) AS trg_ids,
  score FROM spans WHERE src_end > s0 OR trg_end > t0)"""


@query("ladder_to_links", S.with_tables(LADDER, select="""
SELECT pair_id, link_pos, array_to_string(src_ids, ' ') AS src_ids, array_to_string(trg_ids, ' ') AS trg_ids, score FROM ladder"""))
def _(t):
    return align.ladder_to_links(_rungs(t)).withColumn("src_ids", F.array_join("src_ids", " ")).withColumn(
        "trg_ids", F.array_join("trg_ids", " "))


@query("filter_links_by_score", S.with_tables(LADDER, select="""
SELECT pair_id, link_pos, score FROM ladder WHERE score >= -10 AND len(src_ids) <= 2 AND len(trg_ids) <= 2"""))
def _(t):
    return align.filter_links(align.ladder_to_links(_rungs(t))).select("pair_id", "link_pos", "score")


@query("skipped_links", S.with_tables(LADDER, r"""
out AS (SELECT * FROM ladder WHERE NOT (score >= -10 AND len(src_ids) <= 2 AND len(trg_ids) <= 2))""", select="""
SELECT CAST(count(*) AS BIGINT) AS skipped_links, CAST(coalesce(sum(len(src_ids)), 0) AS BIGINT) AS skipped_src,
       CAST(coalesce(sum(len(trg_ids)), 0) AS BIGINT) AS skipped_trg FROM out"""))
def _(t):
    return align.skipped(align.ladder_to_links(_rungs(t)))


@query("link_statistics", S.with_tables(LADDER, select="""
SELECT pair_id, CAST(count(*) AS BIGINT) AS links, CAST(sum(len(src_ids)) AS BIGINT) AS src_sents,
       CAST(sum(len(trg_ids)) AS BIGINT) AS trg_sents,
       CAST(count(*) FILTER (len(src_ids) = 1 AND len(trg_ids) = 1) AS BIGINT) AS one_to_one,
       round(sum(score), 6) AS cost, round(avg(score), 6) AS mean_cost FROM ladder GROUP BY pair_id"""))
def _(t):
    return align.stats(align.ladder_to_links(_rungs(t))).withColumn("cost", F.round("cost", 6)).withColumn(
        "mean_cost", F.round("mean_cost", 6))


@query("filter_links_by_language", S.with_tables(ONE_TO_ONE, r"""
flags AS (SELECT pair_id, 'src' AS side, link_pos AS id, CASE link_pos % 4 WHEN 0 THEN 'xx' ELSE 'un' END AS detected
    FROM steps WHERE link_pos <= src_size AND link_pos % 2 = 0
  UNION ALL SELECT pair_id, 'trg', link_pos, 'un' FROM steps WHERE link_pos <= trg_size AND link_pos % 6 = 0),
seen AS (SELECT s.pair_id, s.link_pos, (s.link_pos <= s.src_size)::INT + (s.link_pos <= s.trg_size)::INT AS n,
    (SELECT count(*) FROM flags f WHERE f.pair_id = s.pair_id AND f.id = s.link_pos AND detected = 'un') AS un,
    (SELECT count(*) FROM flags f WHERE f.pair_id = s.pair_id AND f.id = s.link_pos AND detected <> 'un') AS other
  FROM steps s)""", select="""
SELECT pair_id, CAST(link_pos AS INTEGER) AS link_pos FROM seen WHERE other = 0 AND un < n"""))
def _(t):
    links = align.one_to_one(t.doc_pairs)
    def flagged(side, every, value):
        ids = links.select("pair_id", F.lit(side).alias("side"), F.explode(F.col(f"{side}_ids").cast("array<bigint>")).alias("sent_id"))
        return ids.where(F.col("sent_id") % every == 0).withColumn("detected", value)
    flags = flagged("src", 2, F.when(F.col("sent_id") % 4 == 0, "xx").otherwise("un")).unionByName(
        flagged("trg", 6, F.lit("un")))
    return align.filter_lang(links, flags).select("pair_id", "link_pos")


def _words(t):
    return t.sentences.select(F.col("doc_id").alias("doc"), "sent_pos", F.explode(F.array_distinct(
        X.tokens(F.col("text"), F.col("lang"), "whitespace"))).alias("word"))


def _long_words(t):
    return _words(t).where(F.length("word") >= 4)


ANCHORS = S.PAIRS + "," + S.LINES + r""",
words AS (SELECT DISTINCT doc_id, sent_pos, w AS word FROM (SELECT doc_id, sent_pos, unnest(string_split_regex(text, '\s+')) AS w
  FROM lines) WHERE length(w) >= 4),
hits AS (SELECT d.pair_id, a.sent_pos AS src_pos, b.sent_pos AS trg_pos, a.word FROM doc_pairs d
  JOIN words a ON a.doc_id = d.src_doc JOIN words b ON b.doc_id = d.trg_doc AND b.word = a.word
  WHERE abs(a.sent_pos - b.sent_pos) < 5),
near AS (SELECT *, row_number() OVER (PARTITION BY pair_id, src_pos ORDER BY abs(src_pos - trg_pos), trg_pos, word) AS rn FROM hits),
kept AS (SELECT *, max(trg_pos) OVER (PARTITION BY pair_id ORDER BY src_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last
  FROM near WHERE rn = 1),
anchors AS (SELECT pair_id, src_pos, trg_pos, word FROM kept WHERE last IS NULL OR trg_pos > last)"""


@query("shared_word_anchors", S.with_tables(ANCHORS, select="SELECT pair_id, src_pos, trg_pos, word FROM anchors"))
def _(t):
    w = _long_words(t)
    return align.anchors(w, w, t.doc_pairs, letters=4)


@query("align_between_anchors", S.with_tables(ANCHORS, select="""
SELECT pair_id, src_size AS src_lines, trg_size AS trg_lines, src_size * (src_size + 1) // 2 AS src_sum FROM doc_pairs"""))
def _(t):
    """The pieces between anchors are aligned on their own and together cover every line once."""
    w = _long_words(t)
    pieces = align.segments(line_pairs(t), align.anchors(w, w, t.doc_pairs, letters=4))
    links = align.length_based(pieces)
    return links.groupBy("pair_id").agg(
        F.sum(F.size("src_ids")).alias("src_lines"), F.sum(F.size("trg_ids")).alias("trg_lines"),
        F.sum(F.aggregate("src_ids", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("src_sum"))


OVERLAP = S.PAIRS + "," + S.LINES + r""",
words AS (SELECT DISTINCT doc_id, sent_pos, w AS word FROM (SELECT doc_id, sent_pos, unnest(string_split_regex(text, '\s+')) AS w
  FROM lines) WHERE w <> ''),
counted AS (SELECT *, count(*) OVER (PARTITION BY doc_id, sent_pos) AS n FROM words)"""


@query("sentence_overlap", S.with_tables(OVERLAP, select="""
SELECT d.pair_id, a.sent_pos AS i, b.sent_pos AS j, round(count(*) / greatest(max(a.n), max(b.n)), 9) AS overlap
FROM doc_pairs d JOIN counted a ON a.doc_id = d.src_doc JOIN counted b ON b.doc_id = d.trg_doc AND b.word = a.word
WHERE abs(a.sent_pos * (d.trg_size / greatest(d.src_size, 1)) - b.sent_pos) <= 10 GROUP BY d.pair_id, a.sent_pos, b.sent_pos"""))
def _(t):
    return align.sentence_overlap(_words(t), t.doc_pairs, band=10).withColumn("overlap", F.round("overlap", 9))


@query("align_with_shared_words", S.with_tables(S.PAIRS, select="""
SELECT pair_id, src_size AS src_lines, trg_size AS trg_lines, src_size * (src_size + 1) // 2 AS src_sum,
       trg_size * (trg_size + 1) // 2 AS trg_sum FROM doc_pairs WHERE src_size + trg_size > 0"""))
def _(t):
    """Length and shared words together; again every line is linked once."""
    found = align.sentence_overlap(_words(t), t.doc_pairs)
    links = align.run(align.with_overlap(line_pairs(t), found), "lexical")
    def total(c):
        return F.sum(F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x))
    return links.groupBy("pair_id").agg(
        F.sum(F.size("src_ids")).alias("src_lines"), F.sum(F.size("trg_ids")).alias("trg_lines"),
        total("src_ids").alias("src_sum"), total("trg_ids").alias("trg_sum"))


@query("best_boundary_tag", S.with_tables(S.PAIRS, r"""
tags AS (SELECT doc_id, tag, n FROM (SELECT doc_id, unnest([{'tag': 'p', 'n': len(string_split(text, chr(10)))},
    {'tag': 'q', 'n': len(string_split(text, 'the '))}, {'tag': 'head', 'n': 1}], recursive := true) FROM documents)),
hits AS (SELECT d.pair_id, a.tag, a.n, row_number() OVER (PARTITION BY d.pair_id ORDER BY a.n DESC, a.tag) AS rn FROM doc_pairs d
  JOIN tags a ON a.doc_id = d.src_doc JOIN tags b ON b.doc_id = d.trg_doc AND a.tag = b.tag AND a.n = b.n)""", select="""
SELECT pair_id, tag, CAST(n AS INTEGER) AS n FROM hits WHERE rn = 1"""))
def _(t):
    def tag(name, n):
        return F.struct(F.lit(name).alias("tag"), n.alias("n"))
    tags = t.documents.select(F.col("doc_id").alias("doc"), F.explode(F.array(
        tag("p", F.size(F.split("text", "\n"))), tag("q", F.size(F.split("text", "the "))),
        tag("head", F.lit(1)))).alias("t")).select("doc", "t.tag", "t.n")
    return align.best_boundary_tag(tags, t.doc_pairs)


@query("judgement_counts", """
SELECT user_id, CAST(count(*) FILTER (event_type = 'view') AS BIGINT) AS ok, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS wrong,
       CAST(count(*) FILTER (event_type = 'click') AS BIGINT) AS parts, CAST(count(*) FILTER (event_type = 'signup') AS BIGINT) AS dontknow,
       CAST(count(*) AS BIGINT) AS total FROM events GROUP BY user_id""")
def _(t):
    names = F.create_map(*[F.lit(x) for x in ("view", "ok", "error", "wrong", "click", "parts", "signup", "dontknow")])
    return align.eval_counts(t.events.select("user_id", F.element_at(names, F.col("event_type")).alias("judgement")), "user_id")


# -- whole jobs -----------------------------------------------------------------------------

@query("detect_and_align_statistics")
def _(t):
    out = jobs.align_corpus(t.resources, t.documents, key=["slot", "basename"])
    return out["stats"].withColumn("cost", F.round("cost", 6)).withColumn("mean_cost", F.round("mean_cost", 6))


@query("detect_and_align_catalog", S.with_tables(S.PAIRS, select="""
SELECT path, array_to_string(list_sort(list(DISTINCT other)), ',') AS aligned_with, 'aligned' AS status FROM (
  SELECT src_path AS path, trg_path AS other FROM doc_pairs WHERE src_size > 0 OR trg_size > 0
  UNION ALL SELECT trg_path, src_path FROM doc_pairs WHERE src_size > 0 OR trg_size > 0) GROUP BY path"""))
def _(t):
    updates = jobs.align_corpus(t.resources, t.documents, key=["slot", "basename"])["updates"]
    m = F.col("meta")
    return updates.select("path", m["aligned_with"].alias("aligned_with"), m["status"].alias("status"))


@query("alignment_records", S.with_tables(ONE_TO_ONE, r"""
kinds AS (SELECT pair_id, CASE WHEN link_pos > src_size THEN '0:1' WHEN link_pos > trg_size THEN '1:0' ELSE '1:1' END AS kind, count(*) AS n FROM steps GROUP BY ALL),
listed AS (SELECT pair_id, string_agg(kind || '=' || n, ',' ORDER BY kind) AS types FROM kinds GROUP BY pair_id)""", select="""
SELECT split_part(src_path, '/', 1) || '/' || split_part(src_path, '/', 2) || '/xml/' || src_lang || '-' || trg_lang || '/' || basename AS path,
  greatest(src_size, trg_size) AS size, src_path AS source, trg_path AS target, src_size AS src_sents, trg_size AS trg_sents, types
FROM doc_pairs JOIN listed USING (pair_id)"""))
def _(t):
    """What the catalog records of each alignment."""
    job = jobs.align_corpus(t.resources, t.documents, key=["slot", "basename"], method="one-to-one")
    m = F.col("meta")
    return job["records"].select("path", m["size"].cast("bigint").alias("size"), m["source-document"].alias("source"), m["target-document"].alias("target"),
                                 m["nr-source-sents"].cast("bigint").alias("src_sents"), m["nr-target-sents"].cast("bigint").alias("trg_sents"), m["link-types"].alias("types"))


@query("realign_unaligned_only", S.with_tables(S.PAIRS, select="""
SELECT pair_id FROM doc_pairs d WHERE NOT EXISTS (
  SELECT 1 FROM doc_pairs x WHERE x.src_doc % 2 = 0 AND x.src_path = d.src_path AND x.trg_lang = d.trg_lang)"""))
def _(t):
    return jobs.pairs_to_align(t.doc_pairs, t.doc_pairs.where("src_doc % 2 = 0")).select("pair_id")
