"""Normalisation, segmentation, tokenisation and plain-text reading over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinscript.functions import text as X
from twinscript.operators import align, catalog
from twinscript.plans import sqltables as S
from twinscript.plans.registry import query

SPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def digest(df, c):
    """Key, length and checksum of a text column."""
    return df.select("doc_id", F.length(c).alias("n"), F.md5(c).alias("md5"))


def digest_sql(expr: str, source: str = "documents") -> str:
    return f"SELECT doc_id, CAST(length(t) AS INTEGER) AS n, md5(t) AS md5 FROM (SELECT doc_id, {expr} AS t FROM {source})"


@query("normalize_whitespace", digest_sql(f"trim(regexp_replace(text, '{SPACE}+', ' ', 'g'))"))
def _(t):
    return digest(t.documents, X.normalize(F.col("text"), "whitespace"))


def _ligature_sql(expr: str) -> str:
    for k, v in X.LIGATURES.items():
        expr = f"replace({expr}, '{k}', '{v}')"
    return expr


@query("normalize_ligatures", digest_sql(_ligature_sql(
    "replace(replace(replace(text, 'ti', 'ﬁ'), 'en', 'ﬃ'), '.', '…')")))
def _(t):
    spelled = F.col("text")
    for a, b in (("ti", "ﬁ"), ("en", "ﬃ"), (".", "…")):
        spelled = F.replace(spelled, F.lit(a), F.lit(b))
    return digest(t.documents, X.normalize(spelled, "ligatures"))


@query("normalize_dos", digest_sql("replace(text, chr(10), '')"))
def _(t):
    c = F.concat(F.replace("text", F.lit("\n"), F.lit("\r\n")), F.lit("\f"))
    return digest(t.documents, X.normalize(c, "dos"))


@query("normalize_moses", digest_sql(
    r"replace(regexp_replace(regexp_replace(replace(text, ' de ', '<s>|[ and ]'), '[\x00-\x1f\x7f]', '', 'g'), "
    r"'<(s|unk|/s|\s*and\s*|)>|\[\s*and\s*\]', '', 'g'), '|', '_')"))
def _(t):
    return digest(t.documents, X.normalize(F.replace("text", F.lit(" de "), F.lit("<s>|[ and ]")), "moses"))


@query("normalize_header", S.with_tables(S.LINES, select=r"""
SELECT doc_id, sent_pos, CAST(length(h) AS INTEGER) AS n, md5(h) AS md5 FROM (
  SELECT doc_id, sent_pos, CASE WHEN length(text) <= 26 AND regexp_matches(text, '^\S') THEN text || chr(10)
    ELSE text END AS h FROM lines)"""))
def _(t):
    h = X.normalize(F.col("text"), "header")
    return t.sentences.select("doc_id", "sent_pos", F.length(h).alias("n"), F.md5(h).alias("md5"))


@query("normalize_chain", digest_sql(
    "trim(regexp_replace(replace(regexp_replace(regexp_replace(text, '[\\x00-\\x1f\\x7f]', '', 'g'), "
    f"'<(s|unk|/s|\\s*and\\s*|)>|\\[\\s*and\\s*\\]', '', 'g'), '|', '_'), '{SPACE}+', ' ', 'g'))"))
def _(t):
    return digest(t.documents, X.normalize(F.col("text"), X.WRITE_CHAIN + ",unheard-of"))


@query("clean_xml_characters", digest_sql(
    r"regexp_replace(replace(text, ' ', ' ' || chr(7) || chr(133)), "
    r"'[\x01-\x08\x0B-\x0C\x0E-\x1F\x7F-\x{84}\x{86}-\x{9F}]', '', 'g')"))
def _(t):
    return digest(t.documents, X.clean_xml(F.replace("text", F.lit(" "), F.lit(" \x07\x85"))))


@query("escape_xml_text", digest_sql(
    "replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')",
    "(SELECT page_id AS doc_id, html FROM pages)"))
def _(t):
    return digest(t.pages.withColumnRenamed("page_id", "doc_id"), X.escape_xml(F.col("html")))


def _list(words) -> str:
    return "[" + ", ".join("'" + w + "'" for w in words) + "]::VARCHAR[]"


def _by_lang(table) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {_list(v)}" for k, v in table.items() if k != "en")
    return f"CASE lang {whens} ELSE {_list(table['en'])} END"


OPEN = r"""[''"(\[¿¡\p{Pi}\x{201E}]"""
CLOSE = r"""[''")\]\p{Pf}]"""


def sentence_sql(source: str) -> str:
    """Sentences of ``source(key…, lang, text)`` by a word loop with look-ahead."""
    tidy = r"trim(regexp_replace(regexp_replace({0}, ' +', ' ', 'g'), ' ?\n ?', chr(10), 'g'))"
    rules = [
        rf"([?!]) +({OPEN}*\p{{Lu}})", rf"(\.\.+) +({OPEN}*\p{{Lu}})",
        rf"([?!.] *{CLOSE}+) +({OPEN}* *\p{{Lu}})", rf"([?!.]) +({OPEN}+ *\p{{Lu}})"]
    marked = tidy.format(f"regexp_replace(text, '^{SPACE}+', '')")
    for r in rules:
        marked = f"regexp_replace({marked}, '{r}', '\\1' || chr(10) || '\\2', 'g')"
    run = r"""([\p{L}\p{Nd}.\-]*)([''")\]%\p{Pf}]*)(\.+)$"""
    return rf"""
marked AS (SELECT key, lang, string_split({marked}, ' ') AS words,
             {_by_lang(X.ABBREVIATIONS)} AS always, {_by_lang(X.ABBREVIATIONS_BEFORE_NUMBER)} AS numeric
           FROM {source}),
broken AS (SELECT key, list_transform(words, lambda w, i: CASE
    WHEN i = len(words) OR NOT regexp_matches(w, '\.$') THEN w
    WHEN regexp_extract(w, '{run}', 2) = '' AND list_contains(always, regexp_extract(w, '{run}', 1)) THEN w
    WHEN regexp_matches(w, '\.[\p{{Lu}}\-]+\.+$') THEN w
    WHEN NOT regexp_matches(words[i + 1], '^{OPEN}*[\p{{Lu}}0-9]') THEN w
    WHEN regexp_extract(w, '{run}', 2) = '' AND list_contains(numeric, regexp_extract(w, '{run}', 1))
         AND regexp_matches(words[i + 1], '^[0-9]') THEN w
    ELSE w || chr(10) END) AS words FROM marked),
sents AS (SELECT key, list_filter(string_split({tidy.format("array_to_string(words, ' ')")}, chr(10)),
            lambda s: s <> '') AS ss FROM broken)"""


@query("split_sentences", "WITH src AS (SELECT doc_id AS key, lang, text FROM documents)," + sentence_sql("src") + """
SELECT key AS doc_id, CAST(u.i AS INTEGER) AS sent_pos, u.s AS sentence FROM (
  SELECT key, unnest(list_transform(ss, lambda s, i: {'i': i, 's': s})) AS u FROM sents)""")
def _(t):
    return t.documents.select("doc_id", F.posexplode(X.split_sentences(F.col("text"), F.col("lang"))).alias(
        "p", "sentence")).select("doc_id", (F.col("p") + 1).alias("sent_pos"), "sentence")


LINE_SPACE = r"[\t\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@query("read_plain_text", rf"""
WITH raw AS (SELECT doc_id, lang, replace(text, '. ', '.' || chr(10) || chr(10)) AS text FROM documents),
lines AS (SELECT doc_id, lang, list_transform(string_split(text, chr(10)),
            lambda l: trim(regexp_replace(l, '{LINE_SPACE}+', ' ', 'g'))) AS ls FROM raw),
paras AS (SELECT doc_id, lang, string_split_regex(array_to_string(ls, chr(10)), '\n\n+') AS ps FROM lines),
numbered AS (SELECT doc_id, lang, unnest(list_transform(list_filter(ps, lambda p: trim(p, chr(10)) <> ''),
              lambda p, i: {{'i': i, 'p': p}})) AS u FROM paras),
src AS (SELECT doc_id || ':' || u.i AS key, lang, array_to_string(list_transform(string_split(u.p, chr(10)),
          lambda l: CASE WHEN length(l) <= 26 THEN l || chr(10) ELSE l || ' ' END), '') AS text FROM numbered),
{sentence_sql("src")},
flat AS (SELECT CAST(string_split(key, ':')[1] AS BIGINT) AS doc_id, CAST(string_split(key, ':')[2] AS INTEGER) AS para_id,
           unnest(list_transform(ss, lambda s, i: {{'i': i, 's': s}})) AS u FROM sents)
SELECT doc_id, para_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY para_id, u.i) AS INTEGER) AS sent_pos,
       u.s AS sentence FROM flat""")
def _(t):
    docs = t.documents.select("doc_id", "lang", F.replace("text", F.lit(". "), F.lit(".\n\n")).alias("text"))
    return X.read_text(docs).select("doc_id", "para_id", "sent_pos", "sentence")


def token_sql(source: str) -> str:
    """Tokens of ``source(key, lang, text)`` by a word loop; commas inside numbers are masked."""
    c = r"regexp_replace(' ' || text || ' ', '([^\p{L}\p{M}\p{Nd}\s.''`,\-])', ' \1 ', 'g')"
    c = rf"regexp_replace({c}, '(\.\.+)', ' \1 ', 'g')"
    digits = r"'(\p{N}),(\p{N})', '\1' || chr(1) || '\2', 'g'"
    c = f"replace(replace(regexp_replace(regexp_replace({c}, {digits}), {digits}), ',', ' , '), chr(1), ',')"
    c = f"replace(replace({c}, '`', ''''), '''''', ' \" ')"
    letter = r"[\p{L}\p{M}]"
    # apostrophes are masked by their kind: 2 = attached to the right, 3 = to the left, 4 = apart
    inner = rf"'({letter})''({letter})'"
    en = rf"regexp_replace(regexp_replace(c, {inner}, '\1 ' || chr(2) || '\2', 'g'), {inner}, '\1 ' || chr(2) || '\2', 'g')"
    en = rf"regexp_replace({en}, '(\p{{N}})''s', '\1 ' || chr(2) || 's', 'g')"
    en = rf"replace(regexp_replace({en}, '(\p{{N}})''({letter})', '\1' || chr(4) || '\2', 'g'), '''', ' '' ')"
    en = f"replace(replace({en}, chr(2), ''''), chr(4), '''')"
    fr = rf"regexp_replace(regexp_replace(c, {inner}, '\1' || chr(2) || ' \2', 'g'), {inner}, '\1' || chr(2) || ' \2', 'g')"
    fr = f"replace(replace({fr}, '''', ' '' '), chr(2), '''')"
    return rf"""
spaced AS (SELECT key, lang, {c} AS c FROM {source}),
apart AS (SELECT key, lang, CASE WHEN lang = 'en' THEN {en} WHEN lang IN ('fr', 'it') THEN {fr}
            ELSE replace(c, '''', ' '' ') END AS c FROM spaced),
worded AS (SELECT key, lang, list_filter(string_split_regex(c, '\s+'), lambda w: w <> '') AS words,
             {_by_lang(X.ABBREVIATIONS)} AS always, {_by_lang(X.ABBREVIATIONS_BEFORE_NUMBER)} AS numeric FROM apart),
toks AS (SELECT key, string_split(array_to_string(list_transform(words, lambda w, i: CASE
    WHEN NOT regexp_matches(w, '[^.]\.$') THEN w
    WHEN regexp_matches(w, '\..*\.$') AND regexp_matches(w, '{letter}') THEN w
    WHEN list_contains(always, w[:-2]) THEN w
    WHEN i < len(words) AND regexp_matches(words[i + 1], '^\p{{Ll}}') THEN w
    WHEN i < len(words) AND list_contains(numeric, w[:-2]) AND regexp_matches(words[i + 1], '^[0-9]') THEN w
    ELSE w[:-2] || ' .' END), ' '), ' ') AS toks FROM worded)"""


TOKEN_SOURCE = """src AS (SELECT doc_id AS key, lang,
  replace(replace(replace(text, 'en', 'd''un'), 're ', 'n° 5,300.5 '), ' la ', ' U.S. ') AS text FROM documents),"""


def _prickly(c):
    for a, b in (("en", "d'un"), ("re ", "n° 5,300.5 "), (" la ", " U.S. ")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


@query("tokenize_rules", "WITH " + TOKEN_SOURCE + token_sql("src") + """
SELECT key AS doc_id, CAST(len(toks) AS INTEGER) AS n, md5(array_to_string(toks, ' ')) AS md5 FROM toks""")
def _(t):
    toks = X.tokens(_prickly(F.col("text")), F.col("lang"))
    return t.documents.select("doc_id", toks.alias("t")).select(
        "doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("md5"))


@query("tokenize_unicode", r"""
WITH chars AS (SELECT doc_id, regexp_extract_all(text, '(?s).') AS cs FROM documents),
marked AS (SELECT doc_id, array_to_string(list_transform(cs, lambda c, i:
    CASE WHEN NOT regexp_matches(c, '^\p{P}$') THEN c ELSE
      CASE WHEN i > 1 AND NOT regexp_matches(cs[i - 1], '^\p{P}$') AND
                (i = len(cs) OR regexp_matches(cs[i + 1], '^[\p{P}\s]$')) THEN ' ' ELSE '' END
      || c || CASE WHEN i < len(cs) AND cs[i + 1] = c THEN '' ELSE ' ' END END), '') AS m FROM chars),
toks AS (SELECT doc_id, list_filter(string_split_regex(m, '\s+'), lambda w: w <> '') AS toks FROM marked)
SELECT doc_id, CAST(len(toks) AS INTEGER) AS n, md5(array_to_string(toks, ' ')) AS md5 FROM toks""")
def _(t):
    toks = X.tokens(F.col("text"), F.col("lang"), "unicode")
    return t.documents.select("doc_id", toks.alias("t")).select(
        "doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("md5"))


@query("tokenize_whitespace", r"""
SELECT doc_id, CAST(len(toks) AS INTEGER) AS n, md5(array_to_string(toks, ' ')) AS md5 FROM (
  SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS toks FROM documents)""")
def _(t):
    toks = X.tokens(F.col("text"), F.col("lang"), "whitespace")
    return t.documents.select("doc_id", toks.alias("t")).select(
        "doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("md5"))


@query("token_counts_by_language", "WITH " + TOKEN_SOURCE.replace(
    "replace(replace(replace(text, 'en', 'd''un'), 're ', 'n° 5,300.5 '), ' la ', ' U.S. ') AS text", "text")
       + token_sql("src") + """
SELECT lang, CAST(count(*) AS BIGINT) AS tokens, CAST(count(DISTINCT tok) AS BIGINT) AS types FROM (
  SELECT d.lang, unnest(toks) AS tok FROM toks JOIN documents d ON d.doc_id = toks.key) GROUP BY lang""")
def _(t):
    # counted per type first, so that a common token is one row per task before the shuffle
    types = t.documents.select("lang", F.explode(X.tokens(F.col("text"), F.col("lang"))).alias("tok")).groupBy(
        "lang", "tok").agg(F.count(F.lit(1)).alias("n"))
    return types.groupBy("lang").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("types"))


# tokens of each line with some words made into marks, then put together by rule and by a count
# of the double quotes before each token
@query("detokenize_sentences", S.with_tables(S.LINES, r"""
words AS (SELECT doc_id, sent_pos, lang, list_filter(string_split_regex(replace(replace(replace(replace(replace(
    replace(text, ',', ' ,'), '.', ' .'), ' de ', ' " '), ' the ', ' " '), ' el ', ' ( '), ' on ', ' ''s '), '\s+'),
    lambda w: w <> '') AS w FROM lines),
kinds AS (SELECT doc_id, sent_pos, w, list_transform(w, lambda x, i: CASE
    WHEN regexp_matches(x, '^[\p{Sc}(\[{¿¡]+$') THEN 'r'
    WHEN regexp_matches(x, '^[,.?!:;\\%}\])]+$') THEN 'l'
    WHEN lang = 'en' AND regexp_matches(x, '^''[\p{L}\p{M}]') AND i > 1
         AND regexp_matches(w[i - 1], '[\p{L}\p{M}\p{Nd}]$') THEN 'l'
    WHEN x = '"' THEN CASE WHEN len(list_filter(w[1:i - 1], lambda y: y = '"')) % 2 = 0 THEN 'r' ELSE 'l' END
    ELSE 'w' END) AS k FROM words)""", select=r"""
SELECT doc_id, sent_pos, array_to_string(list_transform(w, lambda x, i:
    CASE WHEN i = 1 OR k[i] = 'l' OR k[i - 1] = 'r' THEN x ELSE ' ' || x END), '') AS text FROM kinds"""))
def _(t):
    c = F.col("text")
    for a, b in ((",", " ,"), (".", " ."), (" de ", ' " '), (" the ", ' " '), (" el ", " ( "), (" on ", " 's ")):
        c = F.replace(c, F.lit(a), F.lit(b))
    toks = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    return t.sentences.select("doc_id", "sent_pos", X.detokenize(toks, F.col("lang")).alias("text"))


@query("tokens_enclosed", S.with_tables(S.LINES, select=r"""
SELECT doc_id, sent_pos, md5(CASE WHEN len(w) = 0 THEN '' ELSE '<w>' || array_to_string(w, '</w><w>') || '</w>' END) AS md5
FROM (SELECT doc_id, sent_pos, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS w FROM lines)"""))
def _(t):
    toks = X.tokens(F.col("text"), F.col("lang"), "whitespace")
    return t.sentences.select("doc_id", "sent_pos", F.md5(X.enclosed(toks, "<w>", "</w>")).alias("md5"))


@query("map_tokens_nested", digest_sql(
    "array_to_string(list_transform(string_split(text, chr(10)), lambda l: replace(l, 'e', '3')), chr(10))"))
def _(t):
    nested = F.split("text", "\n")
    return digest(t.documents, F.array_join(X.map_tokens(nested, "array", lambda l: F.translate(l, "e", "3")), "\n"))


@query("number_sentences", S.with_tables(S.LINES, select="""
SELECT doc_id, CAST(count(*) AS BIGINT) AS n, max(sent_pos) AS last, md5(string_agg(text, '|' ORDER BY sent_pos)) AS md5
FROM lines GROUP BY doc_id"""))
def _(t):
    # the positions come from the document's own row; putting it together again is the check
    return t.documents.select("doc_id", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("s")).where(
        F.size("s") > 0).select("doc_id", F.size("s").cast("bigint").alias("n"), F.size("s").cast("bigint").alias("last"),
                                F.md5(F.array_join("s", "|")).alias("md5"))


@query("running_sentence_lengths", S.with_tables(S.LINES, select="""
SELECT doc_id, sent_pos, CAST(length(text) AS BIGINT) AS length,
       CAST(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY sent_pos) AS BIGINT) AS running FROM lines"""))
def _(t):
    return align.lengths(t.sentences)


@query("sentence_counts", S.with_tables(S.LINES, select="""
SELECT doc_id, CAST(count(*) AS BIGINT) AS size FROM lines GROUP BY doc_id"""))
def _(t):
    return catalog.sizes(t.sentences, "doc_id")


@query("line_range", S.with_tables(S.LINES, select="""
SELECT doc_id, sent_pos, text FROM lines WHERE sent_pos BETWEEN 2 AND 4"""))
def _(t):
    from twinscript.sources.readers import slice_lines
    return slice_lines(t.sentences, 2, 4, "sent_pos").select("doc_id", "sent_pos", "text")
