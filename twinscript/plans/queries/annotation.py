"""Word alignment over the bitext, and annotated tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinscript.operators import annot, words
from twinscript.plans import sqltables as S
from twinscript.plans.registry import query


def _tokens(t, n=words.PREFIX):
    """Bitext as tokens, cut to ``n`` characters unless that is None."""
    def toks(c):
        return words.prefixed(F.filter(F.split(c, r"\s+"), lambda w: w != ""), n)
    return t.bitext.select("pair_id", toks("src_text").alias("src_toks"), toks("trg_text").alias("trg_toks"))


TOKENS = S.BITEXT + r""",
src AS (SELECT pair_id, u.i - 1 AS s, u.w AS src FROM (SELECT pair_id, unnest(list_transform(list_filter(
  string_split_regex(src_text, '\s+'), lambda w: w <> ''), lambda w, i: {'i': i, 'w': lower(w[:4])})) AS u FROM bitext)),
trg AS (SELECT pair_id, u.i - 1 AS t, u.w AS trg FROM (SELECT pair_id, unnest(list_transform(list_filter(
  string_split_regex(trg_text, '\s+'), lambda w: w <> ''), lambda w, i: {'i': i, 'w': lower(w[:4])})) AS u FROM bitext))"""


WHOLE = TOKENS.replace("w[:4]", "w")


def em_sql(name: str, a: str, b: str, rounds: int, prior: str = "") -> str:
    """``{name}(src, trg, p)`` after some rounds, from ``a`` to ``b``."""
    out = rf"""
{name}_a AS (SELECT pair_id, {a} AS src, count(*)::DOUBLE AS src_n FROM {a} GROUP BY ALL),
{name}_b AS (SELECT pair_id, {b} AS trg, count(*)::DOUBLE AS trg_n FROM {b} GROUP BY ALL),
{name}_pairs AS MATERIALIZED (SELECT * FROM {name}_a JOIN {name}_b USING (pair_id)),
{name}_0 AS (SELECT *, 1.0::DOUBLE AS p FROM {name}_pairs)"""
    for i in range(1, rounds + 1):
        now = f"{name}_0" if i == 1 else f"(SELECT x.*, p FROM {name}_pairs x JOIN {name}_t{i - 1} USING (src, trg))"
        last = name if i == rounds else f"{name}_t{i}"
        out += rf""",
{name}_e{i} AS (SELECT src, trg, trg_n * src_n * p / sum(src_n * p) OVER (PARTITION BY pair_id, trg) AS e FROM {now}),
{name}_c{i} AS (SELECT src, trg, sum(e) AS e FROM {name}_e{i} GROUP BY ALL),
{last} AS MATERIALIZED (SELECT src, trg, e / sum(e) OVER (PARTITION BY src) AS p FROM {name}_c{i})"""
    return out


@query("word_cooccurrence", S.with_tables(TOKENS, select="""
SELECT src, trg, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT pair_id, src FROM src) JOIN
  (SELECT DISTINCT pair_id, trg FROM trg) USING (pair_id) GROUP BY ALL"""))
def _(t):
    return words.cooccurrence(_tokens(t))


@query("word_cooccurrence_whole_words", S.with_tables(WHOLE, select="""
SELECT src, trg, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT pair_id, src FROM src) JOIN
  (SELECT DISTINCT pair_id, trg FROM trg) USING (pair_id) GROUP BY ALL"""))
def _(t):
    return words.cooccurrence(_tokens(t, None))


@query("bilingual_lexicon", S.with_tables(TOKENS, em_sql("lex", "src", "trg", 2), select="""
SELECT src, trg, abs(round(ln(p), 5)) AS cost FROM lex"""))
def _(t):
    return words.lexicon(_tokens(t), rounds=2).select("src", "trg", F.abs(F.round(F.log("p"), 5)).alias("cost"))


@query("reverse_lexicon", S.with_tables(TOKENS, em_sql("lex", "trg", "src", 1), select="""
SELECT trg AS src, src AS trg, abs(round(ln(p), 5)) AS cost FROM lex"""))
def _(t):
    table = words.reverse(words.lexicon(words.swap(_tokens(t)), rounds=1))
    return table.select("src", "trg", F.abs(F.round(F.log("p"), 5)).alias("cost"))


DIAGONAL = TOKENS + r""",
sizes AS (SELECT a.pair_id, a.n, b.m FROM (SELECT pair_id, count(*) AS n FROM src GROUP BY 1) a JOIN (SELECT pair_id, count(*) AS m FROM trg GROUP BY 1) b USING (pair_id)),
weights AS (SELECT pair_id, s, t, src, trg, exp(-4.0::DOUBLE * abs((s + 0.5::DOUBLE) / n - (t + 0.5::DOUBLE) / m)) AS w FROM src JOIN trg USING (pair_id) JOIN sizes USING (pair_id)),
dcells AS MATERIALIZED (SELECT *, w / sum(w) OVER (PARTITION BY pair_id, t) AS f, w / sum(w) OVER (PARTITION BY pair_id, s) AS b FROM weights),
counts1 AS (SELECT src, trg, sum(f) AS e, sum(b) AS g FROM dcells GROUP BY ALL),
model1 AS MATERIALIZED (SELECT src, trg, e / sum(e) OVER (PARTITION BY src) AS p, g / sum(g) OVER (PARTITION BY trg) AS q FROM counts1),
shared2 AS (SELECT src, trg, f * p / sum(f * p) OVER (PARTITION BY pair_id, t) AS e, b * q / sum(b * q) OVER (PARTITION BY pair_id, s) AS g
  FROM dcells JOIN model1 USING (src, trg)),
counts2 AS (SELECT src, trg, sum(e) AS e, sum(g) AS g FROM shared2 GROUP BY ALL),
model2 AS MATERIALIZED (SELECT src, trg, e / sum(e) OVER (PARTITION BY src) AS p, g / sum(g) OVER (PARTITION BY trg) AS q FROM counts2)"""


@query("diagonal_lexicon", "WITH " + DIAGONAL + """
SELECT src, trg, abs(round(ln(p), 5)) AS cost, abs(round(ln(q), 5)) AS reverse_cost FROM model2""")
def _(t):
    """Both directions of a lexicon that prefers links near the diagonal, after two rounds."""
    table, known = words.cells(_tokens(t))
    found = words.named(words.diagonal_lexicon(table, rounds=2), known)
    return found.select("src", "trg", F.abs(F.round(F.log("p"), 5)).alias("cost"), F.abs(F.round(F.log("q"), 5)).alias("reverse_cost"))


@query("diagonal_links", "WITH " + DIAGONAL + """,
ranked AS (SELECT pair_id, s, t, row_number() OVER (PARTITION BY pair_id, t ORDER BY round(f * p * 1e9) DESC, s) AS forward,
  row_number() OVER (PARTITION BY pair_id, s ORDER BY round(b * q * 1e9) DESC, t) AS backward FROM dcells JOIN model1 USING (src, trg))
SELECT pair_id, CAST(s AS INTEGER) AS s, CAST(t AS INTEGER) AS t, forward = 1 AS forward, backward = 1 AS backward FROM ranked WHERE forward = 1 OR backward = 1""")
def _(t):
    table, _ = words.cells(_tokens(t))
    forward, backward = words.diagonal_links(table, words.diagonal_lexicon(table, rounds=1))
    both = forward.withColumn("forward", F.lit(True)).join(backward.withColumn("backward", F.lit(True)), ["pair_id", "s", "t"], "full_outer")
    return both.fillna(False, ["forward", "backward"])


FORWARD = TOKENS + "," + em_sql("lex", "src", "trg", 1) + r""",
fwd AS (SELECT pair_id, s, t FROM (SELECT pair_id, s, t, row_number() OVER (PARTITION BY pair_id, t ORDER BY round(p * 1e9) DESC, s) AS rn
  FROM src JOIN trg USING (pair_id) JOIN lex USING (src, trg)) WHERE rn = 1)"""
BACKWARD = FORWARD + "," + em_sql("back", "trg", "src", 1) + r""",
bwd AS (SELECT pair_id, s, t FROM (SELECT pair_id, s, t, row_number() OVER (PARTITION BY pair_id, s ORDER BY round(back.p * 1e9) DESC, t) AS rn
  FROM src JOIN trg USING (pair_id) JOIN back ON back.src = trg.trg AND back.trg = src.src) WHERE rn = 1)"""


def _links(b):
    return words.align(b, words.lexicon(b, rounds=1, packed=True))


def _forward(t):
    return _links(words.numbered(_tokens(t)))


def _both(t):
    """Links of both directions, over sentence pairs stored once."""
    b = words.numbered(_tokens(t))
    return _links(b), _links(words.swap(b)).select("pair_id", F.col("t").alias("s"), F.col("s").alias("t"))


@query("word_links", S.with_tables(FORWARD, select="SELECT pair_id, CAST(s AS INTEGER) AS s, CAST(t AS INTEGER) AS t FROM fwd"))
def _(t):
    return _forward(t)


@query("word_links_whole_words", S.with_tables(FORWARD.replace("w[:4]", "w"), select="SELECT pair_id, CAST(s AS INTEGER) AS s, CAST(t AS INTEGER) AS t FROM fwd"))
def _(t):
    return _links(words.numbered(_tokens(t, None)))


@query("word_links_both_ways", S.with_tables(BACKWARD, select="""
SELECT pair_id, CAST(s AS INTEGER) AS s, CAST(t AS INTEGER) AS t FROM fwd JOIN bwd USING (pair_id, s, t)"""))
def _(t):
    return words.symmetrize(*_both(t), "intersection")


@query("word_links_grown")
def _(t):
    return words.symmetrize(*_both(t))


@query("word_link_clusters")
def _(t):
    return words.clusters(_forward(t)).withColumn("src", F.array_join("src", "+")).withColumn("trg", F.array_join("trg", "+"))


@query("word_link_index", S.with_tables(FORWARD, select="""
SELECT pair_id, string_agg((s + 1) || '-' || (t + 1), ' ' ORDER BY s, t) AS links FROM fwd GROUP BY pair_id"""))
def _(t):
    return words.index(_forward(t), t.bitext.select("pair_id"))


# -- annotated tokens -----------------------------------------------------------------------

def _annotated(t):
    """Tokens of every turn, each with the token at half its position as head."""
    s = t.conversations.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("sent_id"),
        F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("tokens"))
    p = annot.positions(s)
    head = F.floor(F.col("pos") / 2)
    return p.select(
        "sent_id", "pos", "word", F.concat(F.lit("w"), F.col("pos").cast("string")).alias("token_id"),
        F.when(head == 0, F.lit("0")).otherwise(F.concat(F.lit("w"), head.cast("string"))).alias("head"),
        F.lower("word").alias("lemma"), F.when(F.col("pos") % 9 == 0, "SpaceAfter=No").alias("misc"))


WORDS = r"""
words AS (SELECT sent_id, u.i AS pos, u.w AS word, CASE WHEN u.i % 9 = 0 THEN 'SpaceAfter=No' END AS misc FROM (
  SELECT conv_id || '-' || turn AS sent_id, unnest(list_transform(list_filter(string_split_regex(text, '\s+'),
    lambda w: w <> ''), lambda w, i: {'i': i, 'w': w})) AS u FROM conversations))"""


@query("token_positions", S.with_tables(WORDS, select="SELECT sent_id, CAST(pos AS INTEGER) AS pos, word FROM words"))
def _(t):
    return _annotated(t).select("sent_id", "pos", "word")


@query("dependency_heads", S.with_tables(WORDS, select="""
SELECT sent_id, CAST(pos AS INTEGER) AS pos, CAST(pos // 2 AS INTEGER) AS head_pos FROM words"""))
def _(t):
    return annot.resolve_heads(_annotated(t)).select("sent_id", "pos", "head_pos")


@query("dependency_rows", S.with_tables(WORDS, select=r"""
SELECT sent_id, md5(string_agg(array_to_string([pos || '', word, lower(word), '_', '_', '_', (pos // 2) || '', '_', '_',
  coalesce(misc, '_')], chr(9)), chr(10) ORDER BY pos)) AS md5 FROM words GROUP BY sent_id"""))
def _(t):
    return annot.conllu(annot.resolve_heads(_annotated(t))).select("sent_id", F.md5("conllu").alias("md5"))


@query("text_from_dependency_rows", S.with_tables(WORDS, select="""
SELECT sent_id, string_agg(word || CASE WHEN misc IS NULL THEN ' ' ELSE '' END, '' ORDER BY pos) AS text FROM words GROUP BY sent_id"""))
def _(t):
    return annot.raw_text(_annotated(t))
