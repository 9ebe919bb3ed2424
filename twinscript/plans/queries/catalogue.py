"""Catalog reads and writes, parameters, groups and visibility over the derived ``metadata``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from twinscript.functions import lang as L
from twinscript.functions import paths
from twinscript.operators import acl, bitext, catalog
from twinscript.plans import sqltables as S
from twinscript.plans.registry import query
from twinscript.session import scratch

USER = "user3"


def where_query(name: str, cond: str, **conditions: str):
    @query(name, S.with_tables(S.METADATA, select=f"SELECT path FROM metadata WHERE {cond}"))
    def _(t):
        return catalog.search(t.metadata, conditions)


where_query("where_equals", "lang = 'fr'", language="fr")
where_query("where_not", "lang <> 'en'", NOT_language="en")
where_query("where_one_of", "list_has_any(string_split(keywords, ','), ['src3', 'short'])", ONE_OF_keywords="src3,short")
where_query("where_all_of", "list_has_all(string_split(keywords, ','), ['de', 'long'])", ALL_OF_keywords="de,long")
where_query("where_starts_with", "starts_with(path, 'src1')", STARTS_WITH__ID_="src1")
where_query("where_ends_with", "ends_with(path, '/1.xml')", ENDS_WITH__ID_="/1.xml")
where_query("where_includes", "contains(keywords, 'rc1,e')", INCLUDES_keywords="rc1,e")
where_query("where_regex", "regexp_matches(path, '/(fr|es)/[0-9]\\.xml$')", REGEX__ID_=r"/(fr|es)/[0-9]\.xml$")
where_query("where_min_max", "size >= 5 AND size <= 20 AND quality = 1", MIN_size="5", MAX_size="20", MIN_quality="1")


@query("subtree", S.with_tables(S.METADATA, select="SELECT path FROM metadata WHERE starts_with(path, 'src1/')"))
def _(t):
    return catalog.under(t.metadata, "src1").select("path")


def _with_history(t):
    revisions = t.metadata.select("path", F.lit(7).alias("revision"))
    return catalog.archive(t.metadata, revisions)


@query("archive_records", S.with_tables(S.METADATA, select="""
SELECT path, lang, CAST(NULL AS VARCHAR) AS kind FROM metadata UNION ALL
SELECT path || '@7', lang, 'history' FROM metadata"""))
def _(t):
    return _with_history(t).select("path", F.col("meta")["language"].alias("lang"),
                                   F.col("meta")[catalog.HISTORY_FLAG].alias("kind"))


@query("current_records", S.with_tables(S.METADATA, select="SELECT path FROM metadata"))
def _(t):
    return catalog.current(_with_history(t)).select("path")


@query("search_ordered_page", S.with_tables(S.METADATA, select="""
SELECT path, size FROM metadata WHERE lang = 'en' ORDER BY size DESC, path LIMIT 25 OFFSET 10"""))
def _(t):
    typed = t.metadata.withColumn("size", F.col("meta")["size"].cast("bigint"))
    return catalog.search(typed, {"language": "en"}, order="size", descending=True, limit=25, skip=10,
                          full=True).select("path", "size")


@query("deep_pages", S.with_tables(S.METADATA, select="""
SELECT path, size, row_number() OVER (ORDER BY size DESC NULLS LAST, path) - 1 AS place FROM metadata QUALIFY place BETWEEN 60 AND 84 OR place BETWEEN 150 AND 160"""))
def _(t):
    """Two pages far from the start, each read from the ranges that hold it."""
    typed = t.metadata.withColumn("size", F.col("meta")["size"].cast("bigint")).select("path", "size", "meta").repartition(8)
    pages = catalog.Pages.build(typed, scratch(t.spark, "pages"), order="size", descending=True)
    def numbered(skip, limit):
        return pages.page(skip, limit).select("path", "size").withColumn("place", F.lit(skip) + F.row_number().over(
            Window.orderBy(F.col("size").desc(), "path")) - 1)
    return numbered(60, 25).unionByName(numbered(150, 11)).withColumn("place", F.col("place").cast("bigint"))


@query("list_full_records", S.with_tables(S.METADATA, select="""
SELECT path, gid, owner, keywords FROM metadata WHERE lang = 'de'"""))
def _(t):
    m = F.col("meta")
    return catalog.search(t.metadata, {"language": "de"}, full=True).select(
        "path", m["gid"].alias("gid"), m["owner"].alias("owner"), m["keywords"].alias("keywords"))


@query("find_resources", S.with_tables(S.METADATA, select="""
SELECT path FROM metadata WHERE starts_with(path, 'src2/u2/')"""))
def _(t):
    return catalog.find(t.metadata, "corpusfile", "src2/u2").select("path")


@query("aggregate_metadata", S.with_tables(S.METADATA, select="""
SELECT CAST(count(*) AS BIGINT) AS count, CAST(sum(size) AS DOUBLE) AS "SUM_size",
       CAST(max(size) AS DOUBLE) AS "MAX_size", (SELECT path FROM metadata ORDER BY size DESC, path LIMIT 1) AS "MAX_size_path",
       CAST(min(quality) AS DOUBLE) AS "MIN_quality",
       (SELECT path FROM metadata WHERE quality IS NOT NULL ORDER BY quality, path LIMIT 1) AS "MIN_quality_path"
FROM metadata"""))
def _(t):
    return catalog.aggregate(t.metadata, "SUM_size,MAX_size,MIN_quality")


@query("count_matches", S.with_tables(S.METADATA, select="""
SELECT CAST(count(*) AS BIGINT) AS n FROM metadata WHERE size >= 10"""))
def _(t):
    return catalog.where(t.metadata, MIN_size="10").agg(F.count(F.lit(1)).alias("n"))


@query("corpus_languages", S.with_tables(S.RESOURCES, select="""
SELECT slot, branch, array_to_string(list_sort(list(DISTINCT lang)), ',') AS languages FROM resources GROUP BY ALL"""))
def _(t):
    return catalog.languages(t.resources).withColumn("languages", F.array_join("languages", ","))


@query("corpus_language_pairs", S.with_tables(S.PAIRS, select="""
SELECT slot, array_to_string(list_sort(list(DISTINCT src_lang || '-' || trg_lang)), ',') AS pairs
FROM doc_pairs GROUP BY ALL"""))
def _(t):
    return catalog.language_pairs(t.doc_pairs, ("slot",)).withColumn("pairs", F.array_join("pairs", ","))


@query("language_matrix", S.with_tables(S.PAIRS, select="""
SELECT coalesce(src, 'all') AS src, coalesce(trg, 'all') AS trg, CAST(sum(size) AS BIGINT) AS size FROM (
  SELECT lang AS src, lang AS trg, size FROM resources UNION ALL
  SELECT src_lang, trg_lang, least(src_size, trg_size) FROM doc_pairs)
GROUP BY CUBE (src, trg) HAVING src IS NOT NULL OR trg IS NULL"""))
def _(t):
    return catalog.language_matrix(t.resources, t.doc_pairs)


@query("path_parts", S.with_tables(S.RESOURCES, select="""
SELECT path, slot, branch, 'xml' AS base, lang, basename, 'xml' AS kind, nr || '' AS stem,
       slot || '/' || branch || '/tok/' || lang || '/' || basename AS tokenised,
       slot || '/' || branch || '/xml/xx/' || basename AS unknown FROM resources"""))
def _(t):
    p = F.col("path")
    return t.resources.select(
        "path", paths.slot(p).alias("slot"), paths.branch(p).alias("branch"), paths.base(p).alias("base"),
        paths.language(p).alias("lang"), paths.basename(p).alias("basename"), paths.resource_type(p).alias("kind"),
        paths.strip_suffix(paths.basename(p)).alias("stem"), paths.with_base(p, "tok").alias("tokenised"),
        paths.with_language(p, F.lit("xx")).alias("unknown"))


@query("language_codes", """
SELECT d.doc_id, c.two, c.three, c.name_en, c.two || '_' || c.region AS tag FROM documents d JOIN (VALUES
  ('en', 'eng', 'English', 'US'), ('fr', 'fra', 'French', 'FR'), ('de', 'deu', 'German', 'DE'),
  ('es', 'spa', 'Spanish', 'ES')) c(two, three, name_en, region) ON c.two = d.lang""")
def _(t):
    return L.with_codes(t.documents.select("doc_id", "lang"), "lang").drop("lang")


@query("language_any_form_to_two", """
SELECT doc_id, written, lang AS two FROM (SELECT doc_id, lang, CASE doc_id % 5 WHEN 0 THEN lang || '-XX'
    WHEN 1 THEN CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fre' WHEN 'de' THEN 'ger' ELSE 'spa' END
    WHEN 2 THEN CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'FRENCH' WHEN 'de' THEN 'German' ELSE 'spanish' END
    ELSE upper(lang) END AS written FROM documents)""")
def _(t):
    def named(*v):
        return F.element_at(F.create_map(*[F.lit(x) for kv in zip(("en", "fr", "de", "es"), v) for x in kv]), F.col("lang"))
    kind = F.col("doc_id") % 5
    written = (F.when(kind == 0, F.concat("lang", F.lit("-XX"))).when(kind == 1, named("eng", "fre", "ger", "spa"))
               .when(kind == 2, named("English", "FRENCH", "German", "spanish")).otherwise(F.upper("lang")))
    return L.to_two(t.documents.select("doc_id", written.alias("written")), "written", "two")


# -- writes ---------------------------------------------------------------------------------

def _tree(t):
    """Records with one record per branch, which carries the group of everything below."""
    roots = t.resources.groupBy("slot", "branch").agg(F.min("gid").alias("gid"), F.min("owner").alias("owner"))
    root = roots.select(F.concat_ws("/", "slot", "branch").alias("path"), F.create_map(
        F.lit("gid"), F.col("gid"), F.lit("owner"), F.col("owner")).alias("meta"))
    return t.metadata.select("path", "meta").unionByName(root)


ROOTS = """,
roots AS (SELECT slot || '/' || branch AS path, min(gid) AS gid, min(owner) AS owner FROM resources GROUP BY ALL)"""


@query("post_metadata", S.with_tables(S.METADATA + ROOTS, select="""
SELECT m.path, r.gid, CASE WHEN m.lang = 'fr' THEN 'checked' END AS status, m.keywords FROM metadata m
  JOIN roots r ON starts_with(m.path, r.path || '/') WHERE m.lang = 'fr'
UNION ALL SELECT path, gid, NULL, keywords FROM metadata WHERE lang <> 'fr'
UNION ALL SELECT path, gid, NULL, NULL FROM roots"""))
def _(t):
    change = F.create_map(F.lit("status"), F.lit("checked"), F.lit("gid"), F.lit("none"), F.lit("HASH(0x55d0)"), F.lit("x"))
    updates = t.metadata.where(F.col("meta")["language"] == "fr").select("path", change.alias("meta"))
    m = F.col("meta")
    return catalog.post(_tree(t), updates).select(
        "path", m["gid"].alias("gid"), m["status"].alias("status"), m["keywords"].alias("keywords"))


@query("put_metadata", S.with_tables(S.METADATA, select="""
SELECT path, array_to_string(list_sort(list_distinct(list_concat(string_split(keywords, ','), ['long', 'seen']))), ',')
  AS keywords FROM metadata WHERE size >= 5
UNION ALL SELECT path, keywords FROM metadata WHERE size < 5"""))
def _(t):
    change = F.create_map(F.lit("keywords"), F.lit("seen,long"))
    updates = catalog.where(t.metadata, MIN_size="5").select("path", change.alias("meta"))
    return catalog.put(t.metadata, updates).select("path", F.col("meta")["keywords"].alias("keywords"))


@query("delete_metadata", S.with_tables(S.METADATA, select="""
SELECT path, CASE WHEN lang = 'de' THEN NULL ELSE owner END AS owner, CASE WHEN lang = 'de'
  THEN array_to_string(list_filter(string_split(keywords, ','), lambda k: k <> 'long'), ',') ELSE keywords END AS keywords
FROM metadata WHERE lang <> 'es'"""))
def _(t):
    de = catalog.where(t.metadata, language="de").select("path", F.create_map(
        F.lit("owner"), F.lit("*"), F.lit("keywords"), F.lit("long"), F.lit("nothing"), F.lit("*")).alias("meta"))
    es = catalog.where(t.metadata, language="es").select("path", F.lit(None).cast("map<string,string>").alias("meta"))
    m = F.col("meta")
    return catalog.delete(t.metadata, de.unionByName(es)).select(
        "path", m["owner"].alias("owner"), m["keywords"].alias("keywords"))


@query("post_recursive", S.with_tables(S.METADATA, select="""
SELECT path, CASE WHEN starts_with(path, 'src1/') THEN 'frozen' END AS status FROM metadata"""))
def _(t):
    out = catalog.post_recursive(t.metadata, "src1", {"status": "frozen"})
    return out.select("path", F.col("meta")["status"].alias("status"))


@query("put_recursive", S.with_tables(S.METADATA + ROOTS, select="""
SELECT path, CASE WHEN starts_with(path, 'src1/u1/') THEN array_to_string(list_sort(list_distinct(list_concat(
  string_split(keywords, ','), ['kept']))), ',') ELSE keywords END AS keywords FROM metadata
UNION ALL SELECT path, CASE WHEN path = 'src1/u1' THEN 'kept' END FROM roots"""))
def _(t):
    out = catalog.put_recursive(_tree(t), "src1/u1", {"keywords": "kept"})
    return out.select("path", F.col("meta")["keywords"].alias("keywords"))


@query("delete_recursive", S.with_tables(S.METADATA + ROOTS, select="""
SELECT path FROM metadata WHERE NOT starts_with(path, 'src1/u1/') UNION ALL
SELECT path FROM roots WHERE path <> 'src1/u1'"""))
def _(t):
    return catalog.delete_recursive(_tree(t), "src1/u1").select("path")


@query("copy_subtree", S.with_tables(S.METADATA, select="""
SELECT path, owner, CAST(NULL AS VARCHAR) AS status FROM metadata UNION ALL
SELECT 'src3/copy' || path[8:], 'user9', 'copied' FROM metadata WHERE starts_with(path, 'src3/u3')"""))
def _(t):
    m = F.col("meta")
    return catalog.copy(t.metadata, "src3/u3", "src3/copy", "user9").select(
        "path", m["owner"].alias("owner"), m["status"].alias("status"))


@query("revision_history", """
WITH r AS (SELECT 'user/' || user_id AS path, event_id AS revision, event_type AS value FROM events)
SELECT path, revision, value, lag(value) OVER w AS previous, lead(revision) OVER w IS NULL AS is_current
FROM r WINDOW w AS (PARTITION BY path ORDER BY revision)""")
def _(t):
    r = t.events.select(F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("path"),
                        F.col("event_id").alias("revision"), F.col("event_type").alias("value"))
    return catalog.history(r)


@query("catalog_audit", S.with_tables(S.RESOURCES, select="""
SELECT r.path FROM resources r LEFT JOIN labels l ON l.doc_id = r.doc_id WHERE l.doc_id IS NULL"""))
def _(t):
    recorded = t.resources.join(t.labels.select("doc_id"), "doc_id", "left_semi")
    return catalog.audit(t.resources.select("path"), recorded)


@query("catalog_repair", S.with_tables(S.PAIRS, select="""
SELECT path, lang AS language, CAST(NULL AS VARCHAR) AS source_language, 'corpusfile' AS kind,
       'metadata repaired' AS status, size || '' AS size FROM resources UNION ALL
SELECT slot || '/u/xml/' || src_lang || '-' || trg_lang || '/' || basename, src_lang || ',' || trg_lang, src_lang,
       'sentalign', 'metadata repaired', least(src_size, trg_size) || '' FROM doc_pairs"""))
def _(t):
    links = t.doc_pairs.select(F.concat_ws("/", "slot", F.lit("u/xml"), F.concat_ws("-", "src_lang", "trg_lang"),
                                           "basename").alias("path"), F.least("src_size", "trg_size").alias("size"))
    m = F.col("meta")
    return catalog.default_meta(t.resources.select("path", "size").unionByName(links)).select(
        "path", m["language"].alias("language"), m["source-language"].alias("source_language"),
        m["kind"].alias("kind"), m["status"].alias("status"), m["size"].alias("size"))


def _levels(t):
    r = t.resources
    row = ["resource", "level", "key", "value"]
    def layer(level, key, value, keep=None):
        src = r if keep is None else r.where(keep)
        return src.select(F.col("path").alias("resource"), F.lit(level).alias("level"),
                          F.lit(key).alias("key"), value.cast("string").alias("value"))
    out = layer("default", "align_band", F.lit(50))
    for part in (layer("user", "align_band", F.col("doc_id") % 7 + 60, "doc_id % 2 = 0"),
                 layer("corpus", "align_xml_band", F.lit(70), "lang = 'fr'"),
                 layer("corpus", "align_band", F.lit(71), "lang in ('fr', 'de')"),
                 layer("resource", "align_method", F.col("lang"), "size > 10"),
                 layer("default", "other_band", F.lit(1))):
        out = out.unionByName(part)
    return out.select(*row)


@query("effective_parameters", S.with_tables(S.RESOURCES, select="""
SELECT path AS resource, 'band' AS param, CASE WHEN lang = 'fr' THEN '70' WHEN lang = 'de' THEN '71'
    WHEN doc_id % 2 = 0 THEN (doc_id % 7 + 60) || '' ELSE '50' END AS value,
  CASE WHEN lang IN ('fr', 'de') THEN 'corpus' WHEN doc_id % 2 = 0 THEN 'user' ELSE 'default' END AS level FROM resources
UNION ALL SELECT path, 'method', lang, 'resource' FROM resources WHERE size > 10"""))
def _(t):
    return catalog.effective_params(_levels(t), "align_", "xml")


# -- groups and visibility ------------------------------------------------------------------

@query("visible_records", S.with_tables(S.METADATA, S.GROUPS, select=f"""
SELECT path FROM metadata WHERE owner = '{USER}' OR gid IN (
  SELECT gid FROM groups WHERE list_contains(members, '{USER}') AND gid IN ('g0', 'g9'))"""))
def _(t):
    return acl.visible(t.metadata, t.groups, USER, ["g0", "g9"]).select("path")


@query("readable_slots", S.with_tables(S.METADATA, S.GROUPS, select=f"""
SELECT DISTINCT slot FROM metadata WHERE owner = '{USER}' OR gid IN (
  SELECT gid FROM groups WHERE list_contains(members, '{USER}'))"""))
def _(t):
    return acl.slots(t.metadata, t.groups, USER)


@query("record_owner", S.with_tables(S.METADATA + ROOTS, select="""
SELECT path, owner FROM metadata UNION ALL SELECT path, owner FROM roots UNION ALL
SELECT path || '/log', owner FROM roots UNION ALL SELECT 'new/' || path, split_part(path, '/', 1) FROM roots"""))
def _(t):
    tree = _tree(t)
    roots = tree.where(F.size(F.split("path", "/")) == 2)
    none = F.create_map().cast("map<string,string>").alias("meta")
    extra = roots.select(F.concat("path", F.lit("/log")).alias("path"), none).unionByName(
        roots.select(F.concat(F.lit("new/"), "path").alias("path"), none))
    return acl.owner(tree.unionByName(extra))


@query("groups_of_users", S.with_tables(S.GROUPS, select="""
SELECT member, array_to_string(list_sort(list(DISTINCT gid)), ',') AS gids FROM touched GROUP BY member"""))
def _(t):
    return acl.group_counts(t.groups).withColumn("gids", F.array_join("gids", ","))


@query("group_changes", S.with_tables(S.GROUPS, select="""
SELECT gid, owner, array_to_string(CASE gid WHEN 'g0' THEN list_sort(list_distinct(list_append(members, 'new')))
    WHEN 'g1' THEN list_filter(members, lambda m: m <> 'user1') ELSE members END, ',') AS members
FROM groups WHERE gid <> 'g2' UNION ALL SELECT 'g9', 'new', 'new'"""))
def _(t):
    g = acl.create_group(t.groups, "g9", "new")
    g = acl.create_group(g, "g0", "late")
    g = acl.add_member(g, "g0", "new")
    g = acl.remove_member(g, "g1", "user1")
    return acl.delete_group(g, "g2").withColumn("members", F.array_join("members", ","))


@query("set_branch_group", S.with_tables(S.METADATA + ROOTS, select="""
SELECT path, CASE WHEN starts_with(path, 'src4/u4/') AND owner = 'user4' THEN 'gx' ELSE gid END AS gid FROM metadata
UNION ALL SELECT path, CASE WHEN path = 'src4/u4' AND owner = 'user4' THEN 'gx' ELSE gid END FROM roots"""))
def _(t):
    return acl.set_group(_tree(t), "src4/u4", "gx", "user4").select("path", F.col("meta")["gid"].alias("gid"))


@query("aligned_documents", S.with_tables(S.PAIRS, select="""
SELECT src_path, trg_path FROM doc_pairs UNION ALL SELECT trg_path, src_path FROM doc_pairs"""))
def _(t):
    return catalog.aligned(t.doc_pairs)


@query("union_of_corpora", S.with_tables(S.RESOURCES, select="""
SELECT lang AS corpus, path FROM resources"""))
def _(t):
    return bitext.union({code: t.resources.where(F.col("lang") == code).select("path") for code in ("en", "fr", "de", "es")}
                        ).select("corpus", "path")
