"""Document matching over the derived ``resources`` and over ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinscript.functions import lang as L
from twinscript.functions import paths, scores
from twinscript.operators import match
from twinscript.plans import sqltables as S
from twinscript.plans.registry import query

NAMES = """(VALUES ('en', 'eng', 'english'), ('fr', 'fra', 'french'), ('de', 'deu', 'german'),
  ('es', 'spa', 'spanish')) c(two, three, name_en)"""

# one marker per name, so one replacement of the longest form between, before or behind other signs
STRIPPED = rf""",
stripped AS (SELECT r.*, trim(regexp_replace(CASE lang
    WHEN 'en' THEN regexp_replace(stem, '(?i)(^|[^\p{{L}}\p{{N}}])(?:english|eng|en)($|[^\p{{L}}\p{{N}}])', '\1\2')
    WHEN 'fr' THEN regexp_replace(stem, '(?i)(^|[^\p{{L}}\p{{N}}])(?:french|fra|fr)($|[^\p{{L}}\p{{N}}])', '\1\2')
    WHEN 'de' THEN regexp_replace(stem, '(?i)(^|[^\p{{L}}\p{{N}}])(?:german|deu|de)($|[^\p{{L}}\p{{N}}])', '\1\2')
    ELSE regexp_replace(stem, '(?i)(^|[^\p{{L}}\p{{N}}])(?:spanish|spa|es)($|[^\p{{L}}\p{{N}}])', '\1\2') END,
    '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS stripped
  FROM (SELECT *, regexp_replace(name, '\.xml$', '') AS stem FROM resources) r)"""


@query("identical_names", S.with_tables(S.PAIRS, select="""
SELECT pair_id, slot, basename, src_path, trg_path, src_lang, trg_lang FROM doc_pairs"""))
def _(t):
    return t.doc_pairs.select("pair_id", "slot", "basename", "src_path", "trg_path", "src_lang", "trg_lang")


@query("strip_language_from_names", S.with_tables(S.RESOURCES + STRIPPED, select="""
SELECT path, name, stripped FROM stripped"""))
def _(t):
    return match.stripped_names(t.resources, "name").select("path", "name", "stripped")


@query("names_without_language", S.with_tables(S.RESOURCES + STRIPPED, select="""
, one AS (SELECT slot, stripped, lang, max(path) AS path FROM stripped GROUP BY ALL)
SELECT a.path AS src_path, b.path AS trg_path, a.stripped FROM one a JOIN one b
  ON a.slot = b.slot AND a.stripped = b.stripped AND a.lang < b.lang""").replace("\n, one AS", ", one AS"))
def _(t):
    return match.no_lang(t.resources, "name", ("slot",)).select("src_path", "trg_path", "stripped")


@query("name_mentions_language", S.with_tables(S.RESOURCES, select=f"""
SELECT r.path, c.two, contains(lower(r.name), c.two) OR contains(lower(r.name), c.three)
  OR contains(lower(r.name), c.name_en) AS mentioned FROM resources r JOIN {NAMES} ON c.two = r.lang"""))
def _(t):
    codes = F.broadcast(L.codes(t.spark)).select("two", "three", F.col("name").alias("name_en"))
    r = t.resources.join(codes, F.col("lang") == F.col("two"))
    return r.select("path", "two", L.names_language(F.col("name"), F.col("two"), F.col("three"),
                                                    F.col("name_en")).alias("mentioned"))


def _family_names(t):
    """Names with a slip: every seventh document lost its third character, every eleventh has one more."""
    n = F.concat(F.lit("chapter "), F.element_at(F.array(*[F.lit(x) for x in (
        "one", "three", "seven", "eleven", "thirteen")]), (F.col("nr") % 5 + 1).cast("int")), F.lit(" "), F.col("slot"))
    short = F.concat(F.substring(n, 1, 2), F.substring(n, F.lit(4), F.length(n)))
    odd = (F.when(F.col("doc_id") % 7 == 0, short).when(F.col("doc_id") % 11 == 0, F.concat(n, F.lit("x"))).otherwise(n))
    return t.resources.select("slot", "lang", "path", odd.alias("name"))


@query("similar_names", S.with_tables(S.RESOURCES, r"""
named AS (SELECT slot, lang, path, CASE WHEN doc_id % 7 = 0 THEN n[:2] || n[4:] WHEN doc_id % 11 = 0 THEN n || 'x' ELSE n END AS name
  FROM (SELECT *, 'chapter ' || ['one', 'three', 'seven', 'eleven', 'thirteen'][nr % 5 + 1] || ' ' || slot AS n FROM resources)),
langs AS (SELECT DISTINCT lang FROM named),
wanted AS (SELECT DISTINCT n.slot, n.name, l.lang FROM named n JOIN langs l ON n.lang <> l.lang),
names AS (SELECT slot, lang, name, min(path) AS path FROM named GROUP BY ALL),
near AS (SELECT w.slot, w.name, w.lang, levenshtein(w.name, n.name) AS distance, n.path, n.name AS match
  FROM wanted w JOIN names n ON n.slot = w.slot AND n.lang = w.lang
  WHERE levenshtein(w.name, n.name) <= ceil(length(w.name) * 0.1)),
best AS (SELECT *, row_number() OVER (PARTITION BY slot, name, lang ORDER BY distance, path, match) AS rn FROM near)""",
       select="SELECT slot, name, lang, CAST(distance AS INTEGER) AS distance, path, match FROM best WHERE rn = 1"))
def _(t):
    names = _family_names(t)
    langs = F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")])
    wanted = names.select("slot", "name", F.explode(F.array_remove(langs, F.col("lang"))).alias("lang"))
    return match.similar(wanted, names)


@query("language_pairs_of_documents", S.with_tables(S.RESOURCES, select="""
SELECT a.slot, a.nr, a.lang AS src_lang, b.lang AS trg_lang FROM resources a JOIN resources b
  ON a.slot = b.slot AND a.nr = b.nr AND a.lang < b.lang"""))
def _(t):
    return match.pairs(t.resources, ["slot", "nr"]).select("slot", "nr", "src_lang", "trg_lang")


@query("missing_languages", S.with_tables(S.RESOURCES, r"""
fam AS (SELECT DISTINCT slot, 'part ' || nr AS family, lang FROM resources),
langs AS (SELECT DISTINCT slot, lang FROM resources)""", select="""
SELECT f.slot, f.family, l.lang FROM (SELECT DISTINCT slot, family FROM fam) f JOIN langs l USING (slot)
WHERE NOT EXISTS (SELECT 1 FROM fam x WHERE x.slot = f.slot AND x.family = f.family AND x.lang = l.lang)"""))
def _(t):
    fam = t.resources.withColumn("family", F.concat(F.lit("part "), F.col("nr").cast("string")))
    return match.missing(fam, ("slot",), "family")


@query("unaligned_candidates", S.with_tables(S.PAIRS, select="""
SELECT src_path, trg_path FROM (SELECT DISTINCT least(src_path, trg_path) AS src_path, greatest(src_path, trg_path) AS trg_path
  FROM doc_pairs) c
WHERE NOT EXISTS (SELECT 1 FROM doc_pairs d WHERE d.src_path = c.src_path AND d.trg_lang = split_part(c.trg_path, '/', 4)
                  AND d.src_doc % 2 = 0)"""))
def _(t):
    both = t.doc_pairs.select("src_path", "trg_path").unionByName(
        t.doc_pairs.select(F.col("trg_path").alias("src_path"), F.col("src_path").alias("trg_path")))
    return match.unaligned(both, t.doc_pairs.where("src_doc % 2 = 0"))


@query("alignment_candidates", S.with_tables(S.PAIRS, select="""
SELECT src_path, array_to_string(list_sort(list(DISTINCT trg_path)), ',') AS candidates FROM doc_pairs GROUP BY src_path"""))
def _(t):
    return match.candidates(t.doc_pairs).withColumn("candidates", F.array_join("candidates", ","))


@query("match_cascade", S.with_tables(S.RESOURCES + STRIPPED, r"""
staged AS (
  SELECT slot, 'part ' || nr AS family, lang, path, 0 AS stage FROM resources WHERE doc_id % 10 = 0
  UNION ALL SELECT slot, 'part ' || nr, lang, path, 1 FROM resources WHERE lang <> 'fr'
  UNION ALL SELECT slot, stripped, lang, path, 2 FROM stripped),
ranked AS (SELECT *, row_number() OVER (PARTITION BY slot, family, lang ORDER BY stage, path) AS rn FROM staged)""",
       select="SELECT slot, family, lang, path, stage FROM ranked WHERE rn = 1"))
def _(t):
    family = F.concat(F.lit("part "), F.col("nr").cast("string"))
    declared = t.resources.where("doc_id % 10 = 0").withColumn("family", family)
    same = t.resources.where("lang != 'fr'").withColumn("family", family)
    loose = match.stripped_names(t.resources, "name").withColumnRenamed("stripped", "family")
    return match.cascade([declared, same, loose])


@query("scored_candidates", S.with_tables(S.PAIRS + STRIPPED, rf"""
one AS (SELECT slot, stripped, lang, max(path) AS path FROM stripped GROUP BY ALL),
marked AS (SELECT s.*, regexp_replace(s.name, '(?i)^(.*?)' || CASE WHEN contains(lower(s.name), c.name_en) THEN c.name_en
    WHEN contains(lower(s.name), c.three) THEN c.three ELSE c.two END, '\1') AS bare
  FROM stripped s JOIN one USING (path) JOIN {NAMES} ON c.two = s.lang),
cross_pairs AS (SELECT a.path AS src_path, b.path AS trg_path, a.size AS ss, b.size AS ts,
    (1 - 0.0 / (length(a.bare) + length(b.bare))) AS raw, a.bare AS x, b.bare AS y
  FROM marked a JOIN marked b ON a.slot = b.slot AND a.stripped = b.stripped AND a.lang < b.lang),
rated AS (SELECT src_path, trg_path, least(ss, ts) / greatest(ss, ts) AS size_match,
    CASE WHEN x = y THEN 1.0::DOUBLE END * (least(length(src_path), length(trg_path))::DOUBLE
         / greatest(length(src_path), length(trg_path))) AS name_match FROM cross_pairs),
known AS (SELECT DISTINCT src_path, trg_path FROM doc_pairs WHERE src_doc % 4 = 0)""", select="""
SELECT src_path, trg_path, round(name_match, 9) AS name_match, round(size_match, 9) AS size_match,
       round(0.8 * name_match + 0.2 * size_match, 9) AS match, FALSE AS aligned
FROM rated WHERE size_match >= 0.7 AND name_match >= 0.9
  AND NOT EXISTS (SELECT 1 FROM known k WHERE k.src_path = rated.src_path AND k.trg_path = rated.trg_path)
UNION ALL SELECT src_path, trg_path, NULL, NULL, 1.0::DOUBLE, TRUE FROM known"""))
def _(t):
    known = t.doc_pairs.where("src_doc % 4 = 0")
    out = match.scored(t.resources, known, "name", stretches=False)
    return out.select("src_path", "trg_path", *[F.round(c, 9).alias(c) for c in ("name_match", "size_match", "match")], "aligned")


@query("scored_candidates_by_stretch")
def _(t):
    """With names that differ in one more stretch; which of several equally near documents stands for them has no SQL, tests compare small sets."""
    out = match.scored(t.resources, t.doc_pairs.where("src_doc % 4 = 0"), "name")
    return out.select("src_path", "trg_path", *[F.round(c, 9).alias(c) for c in ("name_match", "size_match", "match")], "aligned")


@query("families_without_languages", S.with_tables(S.RESOURCES + STRIPPED, r"""
langs AS (SELECT DISTINCT lang FROM resources),
asked AS (SELECT DISTINCT r.slot, 'Part ' || r.nr || ' English-fra' AS family, l.lang FROM resources r JOIN langs l ON l.lang NOT IN ('en', 'fr')),
one AS (SELECT slot, lang, lower(stripped) AS name, max(path) AS path FROM (SELECT slot, lang, path, stripped FROM stripped) GROUP BY ALL)""", select="""
SELECT a.slot, a.family, a.lang, o.path FROM asked a JOIN one o ON o.slot = a.slot AND o.lang = a.lang AND o.name = lower(replace(a.family, ' English-fra', ''))"""))
def _(t):
    """Families named after two of their languages, and the documents of the others whose names are the same without any."""
    family = F.concat(F.lit("Part "), F.col("nr").cast("string"), F.lit(" English-fra"))
    lower = t.resources.withColumn("name", F.lower("name"))
    asked = t.resources.select("slot", family.alias("family"), F.array(F.lit("en"), F.lit("fr")).alias("langs"),
                               F.explode(F.array(F.lit("de"), F.lit("es"))).alias("lang")).distinct()
    named = asked.withColumn("family", F.lower("family"))
    found = match.without_languages(named, lower, "name")
    return found.select("slot", F.concat(F.lit("Part "), F.regexp_extract("family", r"(\d+)", 1), F.lit(" English-fra")).alias("family"), "lang", "path")


# -- links between pages --------------------------------------------------------------------

def _pages(t):
    """Pages 2k and 2k+1 as the English and French version of one file of a site.

    Most name the other version in an alternate link, some in a language switcher, some nowhere.
    """
    lang = F.when(F.col("page_id") % 2 == 0, "en").otherwise("fr")
    other = F.when(F.col("page_id") % 2 == 0, "fr").otherwise("en")
    no = F.floor(F.col("page_id") / 2).cast("string")
    alternate = F.concat(F.lit('<link rel="alternate" hreflang="'), other, F.lit('-XX" href="https://x.example/'),
                         other, F.lit("/"), no, F.lit('">'))
    switcher = F.concat(F.lit('<ul class="menu menu--language-switcher"><li><a href="../'), other, F.lit("/"), no,
                        F.lit('">'), F.upper(other), F.lit("</a></li></ul>"))
    declared = (F.when(F.col("page_id") % 5 == 0, "").when(F.col("page_id") % 3 == 0, switcher).otherwise(alternate))
    return t.pages.select("page_id", lang.alias("lang"), F.concat_ws("/", lang, F.concat(no, F.lit(".html"))).alias("path"),
                          F.concat(declared, F.col("html")).alias("html"))


PAGES = r"""
files AS (SELECT page_id, html, CASE page_id % 2 WHEN 0 THEN 'en' ELSE 'fr' END AS lang,
                 CASE page_id % 2 WHEN 0 THEN 'fr' ELSE 'en' END AS other, page_id // 2 AS no FROM pages),
links AS (
  SELECT page_id, lang || '/' || no || '.html' AS page, other AS lang, CASE WHEN page_id % 3 = 0
    THEN '../' || other || '/' || no || '.html' ELSE 'https://x.example/' || other || '/' || no || '.html' END AS href
  FROM files WHERE page_id % 5 <> 0
  UNION ALL SELECT page_id, lang || '/' || no || '.html', 'en', regexp_extract(html,
    '(?i)href="([^"]+)"[^>]*>\s*(?:in english|en|en-us|en-uk|en_us|en_uk|eng)\s*<', 1)
  FROM files WHERE page_id % 5 = 0 AND regexp_matches(html,
    '(?i)href="([^"]+)"[^>]*>\s*(?:in english|en|en-us|en-uk|en_us|en_uk|eng)\s*<'))"""


@query("extract_language_links", S.with_tables(PAGES, select="SELECT page, lang, href FROM links"))
def _(t):
    return match.extract_links(_pages(t))


@query("resolve_links", r"""
WITH l AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/(.*)$', 1) AS page,
  unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
SELECT page_id, href, CASE WHEN href LIKE '/%' THEN ltrim(href, '/')
  ELSE regexp_replace(page, '/?[^/]*$', '') || '/' || href END AS target FROM l""")
def _(t):
    page = F.regexp_extract("url", r"^https?://[^/]+/(.*)$", 1)
    links = t.pages.select("page_id", page.alias("page"),
                           F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.select("page_id", "href", paths.resolve_href(F.col("href"), F.col("page")).alias("target"))


@query("language_link_matches", S.with_tables(PAGES, r"""
imported AS (SELECT lang || '/' || no || '.html' AS imported_from, 'c/u/xml/' || lang || '/' || page_id || '.xml' AS path FROM files),
targets AS (SELECT page, lang, regexp_replace(regexp_replace(href, '^https://[^/]*/', ''), '^(\.\./|/)', '') AS target FROM links)""",
       select="""
SELECT s.path AS src_path, l.lang AS trg_lang, f.path AS trg_path FROM targets l
  JOIN imported s ON s.imported_from = l.page JOIN imported f ON f.imported_from = l.target
WHERE l.target <> l.page"""))
def _(t):
    pages = _pages(t)
    imported = pages.select(F.col("path").alias("imported_from"), F.concat(
        F.lit("c/u/xml/"), "lang", F.lit("/"), F.col("page_id").cast("string"), F.lit(".xml")).alias("path"))
    return match.language_links(match.extract_links(pages), imported)


# -- similarity of names --------------------------------------------------------------------

@query("name_infixes", S.with_tables(S.PAIRS, r"""
n AS (SELECT d.pair_id, a.name AS x, b.name AS y FROM doc_pairs d JOIN resources a ON a.path = d.src_path
  JOIN resources b ON b.path = d.trg_path),
p AS (SELECT *, len(list_filter(range(1, least(length(x), length(y)) + 1), lambda i: lower(x[:i]) = lower(y[:i]))) AS pre,
  len(list_filter(range(1, least(length(x), length(y)) + 1),
      lambda i: lower(right(x, i)) = lower(right(y, i)))) AS post FROM n),
q AS (SELECT *, least(post, least(length(x), length(y)) - pre) AS suf FROM p)""", select="""
SELECT pair_id, substring(x, pre + 1, length(x) - pre - suf) AS src_infix,
       substring(y, pre + 1, length(y) - pre - suf) AS trg_infix FROM q"""))
def _(t):
    a, b = scores.infixes(F.col("src_name"), F.col("trg_name"))
    return t.doc_pairs.select("pair_id", a.alias("src_infix"), b.alias("trg_infix"))


@query("name_subsequences")
def _(t):
    a, b = F.col("src_name"), F.col("trg_name")
    return t.doc_pairs.select("pair_id", scores.lcs_length(a, b).alias("lcs"), F.round(scores.lcs_ratio(a, b), 9).alias("ratio"))


@query("name_differences")
def _(t):
    d = scores.difference_pairs(F.col("src_name"), F.col("trg_name"))
    return t.doc_pairs.select("src_lang", "trg_lang", F.explode(d).alias("d")).groupBy(
        "src_lang", "trg_lang", "d.a", "d.b").agg(F.count(F.lit(1)).alias("n"))
