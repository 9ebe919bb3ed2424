"""Formats written by Spark from the given tables and read back, and the intake of files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from twinscript.functions import text as X
from twinscript.operators import align, ingest
from twinscript.plans import jobs
from twinscript.plans import sqltables as S
from twinscript.plans.queries.aligning import LADDER, _rungs
from twinscript.plans.registry import query
from twinscript.session import scratch
from twinscript.sources import charsets, markup, readers, writers

SPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _units(t):
    """The bitext as long translation units; every fifth has one language only."""
    both = F.array(F.struct(F.lit("en").alias("lang"), F.col("src_text").alias("seg")),
                   F.struct(F.lit("fr").alias("lang"), F.col("trg_text").alias("seg")))
    kept = F.when(F.col("conv_id") % 5 == 0, F.slice(both, 1, 1)).otherwise(both)
    return t.bitext.select(F.col("pair_id").alias("tu_id"), F.explode(kept).alias("x")).select("tu_id", "x.lang", "x.seg")


UNITS = S.BITEXT + rf""",
units AS (SELECT pair_id AS tu_id, 'en' AS lang, trim(regexp_replace(src_text, '{SPACE}+', ' ', 'g')) AS seg FROM bitext WHERE conv_id % 5 <> 0
  UNION ALL SELECT pair_id, 'fr', trim(regexp_replace(trg_text, '{SPACE}+', ' ', 'g')) FROM bitext WHERE conv_id % 5 <> 0)"""


@query("translation_memory", S.with_tables(UNITS, select="SELECT tu_id, lang, seg FROM units"))
def _(t):
    path = scratch(t.spark, "tmx")
    writers.tmx(_units(t), path, files=4)
    return readers.tmx(t.spark, path).select("tu_id", "lang", "seg")


@query("translation_memory_unique", S.with_tables(S.BITEXT, select=rf"""
SELECT lang, md5(seg) AS md5, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'de' AS lang, trim(regexp_replace(src_text, '{SPACE}+', ' ', 'g')) AS seg FROM (SELECT DISTINCT src_text, trg_text FROM bitext)
  UNION ALL SELECT 'es', trim(regexp_replace(trg_text, '{SPACE}+', ' ', 'g')) FROM (SELECT DISTINCT src_text, trg_text FROM bitext))
GROUP BY ALL"""))
def _(t):
    path = scratch(t.spark, "tmx-unique")
    writers.tmx_unique(t.bitext.unionByName(t.bitext), path, "de", "es", files=4)
    return readers.tmx(t.spark, path).groupBy("lang", F.md5("seg").alias("md5")).agg(F.count(F.lit(1)).alias("n"))


@query("xliff_units", S.with_tables(S.BITEXT, select=rf"""
SELECT 'c' || conv_id AS original, turn || '' AS unit_id, 'en' AS src_lang, 'fr' AS trg_lang,
       md5(trim(regexp_replace(src_text, '{SPACE}+', ' ', 'g'))) AS source, md5(trim(regexp_replace(trg_text, '{SPACE}+', ' ', 'g'))) AS target
FROM bitext"""))
def _(t):
    path = scratch(t.spark, "xliff")
    def shown(c):
        return X.escape_xml(X.whitespace(X.clean_xml(F.col(c))))
    unit = F.concat(F.lit('<file original="c'), F.col("conv_id").cast("string"),
                    F.lit('" source-language="en" target-language="fr"><body><trans-unit id="'), F.col("turn").cast("string"),
                    F.lit('"><source>'), shown("src_text"), F.lit("</source><target>"), shown("trg_text"),
                    F.lit("</target></trans-unit></body></file>"))
    rows = t.bitext.select(writers.bucket("pair_id", 4).alias("file"), "pair_id", unit.alias("line"))
    writers.write_framed(rows, path, ["pair_id"], F.lit('<xliff version="1.2">'), F.lit("</xliff>"))
    return readers.xliff(t.spark, path).select("original", "unit_id", "src_lang", "trg_lang",
                                               F.md5("source").alias("source"), F.md5("target").alias("target"))


@query("moses_lines", S.with_tables(S.BITEXT, rf"""
lined AS (SELECT conv_id, turn, trim(regexp_replace(replace(replace(src_text, chr(10), ' '), '|', '_'), '  +', ' ', 'g')) AS en,
    trim(regexp_replace(replace(replace(trg_text, chr(10), ' '), '|', '_'), '  +', ' ', 'g')) AS fr FROM bitext
  WHERE trim(src_text) <> '' AND trim(trg_text) <> '' AND length(src_text) <= 600 AND length(trg_text) <= 600)""", select="""
SELECT row_number() OVER (ORDER BY conv_id, turn) AS line_no, en, fr FROM lined"""))
def _(t):
    path = scratch(t.spark, "moses")
    writers.moses(t.bitext, path, "en", "fr", ["conv_id", "turn"], lines_per_file=50, max_length=600)
    lines = readers.numbered_lines(t.spark, path).withColumn("file", F.regexp_extract("file", r"file=([^/]+)/", 1))
    part = F.regexp_extract("base", r"(\d+)$", 1).cast("bigint")
    return readers.moses(lines, "en", "fr").select((part * 50 + F.col("line_no")).alias("line_no"), "en", "fr")


@query("text_export_lines", S.with_tables(S.BITEXT, select=r"""
SELECT md5(trim(regexp_replace(replace(replace(src_text, chr(10), ' '), '|', '_'), '  +', ' ', 'g'))) AS md5,
       CAST(count(*) AS BIGINT) AS n FROM bitext GROUP BY 1"""))
def _(t):
    path = scratch(t.spark, "text")
    writers.text(t.bitext, path, "src_text", ["conv_id", "turn"])
    lines = readers.numbered_lines(t.spark, path)
    return lines.groupBy(F.md5("text").alias("md5")).agg(F.count(F.lit(1)).alias("n"))


@query("factored_tokens", S.with_tables(S.LINES, select=r"""
SELECT doc_id, sent_pos, md5(array_to_string(list_transform(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''),
  lambda w: replace(w, '|', '_') || '|' || replace(lower(w), '|', '_')), ' ')) AS md5 FROM lines"""))
def _(t):
    toks = F.transform(X.tokens(F.col("text"), F.col("lang"), "whitespace"),
                       lambda w: F.struct(w.alias("word"), F.lower(w).alias("lemma")))
    return t.sentences.select("doc_id", "sent_pos", F.md5(writers.factored(toks, ["word", "lemma"])).alias("md5"))


def _corpus_files(t):
    """Corpus files of 64 documents, ten lines to a paragraph."""
    para = F.concat_ws(".", F.col("doc_id").cast("string"), (F.floor((F.col("sent_pos") - 1) / 10) + 1).cast("string"))
    return t.sentences.select(F.concat(F.lit("d"), F.floor(F.col("doc_id") / 64).cast("string")).alias("file"),
                              para.alias("para_id"), "sent_pos",
                              F.when(F.col("sent_pos") % 3 == 0, F.col("lang")).alias("lang"), "text")


@query("corpus_xml_sentences", S.with_tables(S.LINES, select=r"""
SELECT 'd' || doc_id // 64 AS file, doc_id || '.' || ((sent_pos - 1) // 10 + 1) AS para_id, sent_pos || '' AS sent_id,
       CASE WHEN sent_pos % 3 = 0 THEN lang END AS lang, md5(trim(text)) AS md5 FROM lines"""))
def _(t):
    path = scratch(t.spark, "corpus")
    writers.corpus_xml(_corpus_files(t), path)
    return readers.corpus_xml(t.spark, path).select(
        F.regexp_extract("file", r"file=([^/]+)/", 1).alias("file"), "para_id", "sent_id", "lang",
        F.md5(F.trim("text")).alias("md5"))


@query("corpus_folder_counts", S.with_tables(S.LINES, select="""
SELECT 'd' || doc_id // 64 AS file, CAST(count(*) AS BIGINT) AS records FROM lines GROUP BY 1"""))
def _(t):
    path = scratch(t.spark, "folder")
    writers.corpus_xml(_corpus_files(t), path)
    _, counts = readers.corpus_dir(t.spark, path)
    return counts.withColumn("file", F.regexp_extract("file", r"file=([^/]+)/", 1))


@query("alignment_files", S.with_tables(LADDER, select="""
SELECT d.src_path, d.trg_path, array_to_string(src_ids, ' ') AS src_ids, array_to_string(trg_ids, ' ') AS trg_ids, score
FROM ladder JOIN doc_pairs d USING (pair_id)"""))
def _(t):
    path = scratch(t.spark, "xces")
    named = t.doc_pairs.select("pair_id", "src_path", "trg_path",
                               writers.bucket("pair_id", 8).alias("file"))
    writers.xces(align.ladder_to_links(_rungs(t)).join(named, "pair_id"), path)
    out = readers.xces(t.spark, path)
    return out.select("src_path", "trg_path", F.array_join("src_ids", " ").alias("src_ids"),
                      F.array_join("trg_ids", " ").alias("trg_ids"), "score")


@query("convert_memory_to_text", S.with_tables(UNITS, select=r"""
SELECT md5(trim(regexp_replace(replace(seg, '|', '_'), '  +', ' ', 'g'))) AS md5, CAST(count(*) AS BIGINT) AS n FROM units GROUP BY 1"""))
def _(t):
    source, sink = scratch(t.spark, "memory"), scratch(t.spark, "converted")
    writers.tmx(_units(t), source, files=4)
    jobs.convert(t.spark, "tmx", source, "text", sink, column="seg", order=["tu_id", "lang"])
    return readers.numbered_lines(t.spark, sink).groupBy(F.md5("text").alias("md5")).agg(F.count(F.lit(1)).alias("n"))


@query("read_any_xml", r"""
WITH body AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->|<\?.*?\?>|<!\[?[A-Z].*?>|<head\b.*?</head>', '', 'g') AS b FROM pages),
pieces AS (SELECT page_id, list_filter(list_transform(string_split_regex(b, '<[^>]+>'), lambda x: trim(regexp_replace(
  replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&'),
  '""" + SPACE + r"""+', ' ', 'g'))), lambda x: x <> '') AS ps FROM body)
SELECT page_id, CAST(len(ps) AS BIGINT) AS segments, md5(replace(array_to_string(ps, ' '), ' ', '')) AS md5 FROM pieces
WHERE len(ps) > 0""")
def _(t):
    """Segments per page, and their sentences put together without blanks."""
    out = readers.xml_segments(t.pages.select("page_id", F.col("html").alias("text")))
    return out.groupBy("page_id").agg(
        F.max("seg_pos").cast("bigint").alias("segments"),
        F.md5(F.replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_pos", "sent_pos", "sentence"))),
                                                 lambda x: x["sentence"]), ""), F.lit(" "), F.lit(""))).alias("md5"))


@query("subtitle_cues", S.with_tables(S.LINES, select=r"""
SELECT doc_id, CAST(sent_pos AS INTEGER) AS cue, sent_pos * 2.5::DOUBLE AS t_start, sent_pos * 2.5::DOUBLE + 61.25 AS t_end,
       md5(trim(regexp_replace(regexp_replace(regexp_replace('"<i>' || text || '</i>"', '""+', '"', 'g'), '<[^>]+>', '', 'g'), '"""
       + SPACE + r"""+', ' ', 'g'))) AS md5 FROM lines"""))
def _(t):
    def stamp(sec):
        return F.format_string("%02d:%02d:%02d,%03d", F.floor(sec / 3600), F.floor(sec % 3600 / 60),
                               F.floor(sec % 60), F.round(sec * 1000 % 1000).cast("bigint"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    def cue(x, i):
        start = (i + 1) * 2.5
        return F.concat((i + 1).cast("string"), F.lit("\r\n"), stamp(start), F.lit(" --> "), stamp(start + 61.25),
                        F.lit("\r\n{y:i}''"), F.concat(F.lit("<i>"), x, F.lit("</i>''\r\n")))
    files = t.documents.select("doc_id", F.array_join(F.transform(lines, cue), "\r\n").alias("text"))
    return readers.srt(files).select("doc_id", "cue", "t_start", "t_end", F.md5("text").alias("md5"))


@query("decode_charsets", """
SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 1) THEN 'UTF-8' WHEN doc_id % 5 = 2 THEN 'UTF-16LE' WHEN doc_id % 5 = 3 THEN 'UTF-16BE'
  WHEN regexp_matches(text, '[^\\x00-\\x7f]') THEN 'windows-1252' ELSE 'UTF-8' END AS charset, md5(text) AS md5 FROM documents""")
def _(t):
    t.spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    kind = F.col("doc_id") % 5
    marked = F.concat(F.lit("﻿"), "text")
    content = (F.when(kind == 0, F.encode("text", "UTF-8")).when(kind == 1, F.encode(marked, "UTF-8"))
               .when(kind == 2, F.encode(marked, "UTF-16LE")).when(kind == 3, F.encode(marked, "UTF-16BE"))
               .otherwise(F.encode("text", "windows-1252")))
    files = t.documents.select("doc_id", "lang", content.alias("content"))
    return readers.decode_text(files).select("doc_id", "charset", F.md5("text").alias("md5"))


def _long_units(t):
    """Lines at the same place of documents of one family, as units of up to four languages."""
    r = t.resources.select("doc_id", F.concat_ws("/", "slot", F.col("nr").cast("string")).alias("doc"))
    return t.sentences.join(r, "doc_id").select("doc", F.col("sent_pos").alias("tu_id"), "lang", F.col("text").alias("seg"))


FAMILIES = S.RESOURCES + "," + S.LINES + r""",
tus AS (SELECT r.slot || '/' || r.nr AS doc, l.sent_pos AS tu_id, l.lang FROM lines l JOIN resources r USING (doc_id))"""


@query("normalised_links", S.with_tables(FAMILIES, select="""
SELECT a.doc, a.tu_id, a.lang AS src_lang, b.lang AS trg_lang FROM tus a JOIN tus b
  ON a.doc = b.doc AND a.tu_id = b.tu_id AND a.lang < b.lang"""))
def _(t):
    return writers.normalised(_long_units(t))["links"]


@query("normalised_sizes", S.with_tables(FAMILIES, select="""
SELECT doc, lang AS kind, CAST(count(*) AS BIGINT) AS size FROM tus GROUP BY ALL UNION ALL
SELECT a.doc, a.lang || '-' || b.lang, CAST(count(*) AS BIGINT) FROM tus a JOIN tus b
  ON a.doc = b.doc AND a.tu_id = b.tu_id AND a.lang < b.lang GROUP BY ALL"""))
def _(t):
    return writers.normalised(_long_units(t))["sizes"]


@query("normalised_partners", S.with_tables(FAMILIES, select="""
SELECT a.doc, a.lang, array_to_string(list_sort(list(DISTINCT b.lang)), ',') AS aligned_with FROM tus a JOIN tus b
  ON a.doc = b.doc AND a.tu_id = b.tu_id AND a.lang <> b.lang GROUP BY ALL"""))
def _(t):
    return writers.normalised(_long_units(t))["aligned_with"].withColumn("aligned_with", F.array_join("aligned_with", ","))


# -- intake ---------------------------------------------------------------------------------

FILES = r"""
files AS (SELECT doc_id, 'uploads/' || CASE doc_id % 6 WHEN 0 THEN 'moses/p.' || lang WHEN 1 THEN 'x/.hidden.txt'
  WHEN 2 THEN 'html/a%20' || doc_id WHEN 3 THEN 'x/b' || doc_id || '.TMX.gz' WHEN 4 THEN 'x/c' || doc_id || '.xyz'
  ELSE 'x/d' || doc_id || '.srt' END AS path FROM documents)"""


def _files(t):
    k, n = F.col("doc_id") % 6, F.col("doc_id").cast("string")
    name = (F.when(k == 0, F.concat(F.lit("moses/p."), "lang")).when(k == 1, "x/.hidden.txt")
            .when(k == 2, F.concat(F.lit("html/a%20"), n)).when(k == 3, F.concat(F.lit("x/b"), n, F.lit(".TMX.gz")))
            .when(k == 4, F.concat(F.lit("x/c"), n, F.lit(".xyz"))).otherwise(F.concat(F.lit("x/d"), n, F.lit(".srt"))))
    return t.documents.select("doc_id", F.concat(F.lit("uploads/"), name).alias("path"))


@query("route_formats", S.with_tables(FILES, select="""
SELECT doc_id, replace(path, '%20', ' ') AS name, CASE doc_id % 6 WHEN 0 THEN 'moses' WHEN 1 THEN 'text' WHEN 2 THEN 'html'
  WHEN 3 THEN 'tmx' WHEN 4 THEN 'unknown' ELSE 'srt' END AS format FROM files"""))
def _(t):
    return ingest.route(_files(t)).select("doc_id", "name", "format")


@query("select_uploads", S.with_tables(FILES, select="SELECT doc_id, path FROM files WHERE doc_id % 6 IN (3, 5)"))
def _(t):
    return ingest.select(_files(t))


def _validated(t):
    """Documents as members of an archive per source: unlabelled ones count as broken, short ones as empty."""
    r = t.resources.join(t.labels, "doc_id", "left")
    return ingest.validate(r.select(F.col("slot").alias("archive"), "path",
                                    F.when(F.col("size") < 3, 0).otherwise(F.col("size")).alias("records"),
                                    F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("broken")))


VALIDATED = S.RESOURCES + r""",
validated AS (SELECT slot AS archive, path, CASE WHEN coalesce(l.toxic, 0) = 1 THEN 'failed' WHEN size < 3 THEN 'empty' ELSE 'ok' END AS outcome
  FROM resources r LEFT JOIN labels l USING (doc_id))"""


@query("import_outcomes", S.with_tables(VALIDATED, select="SELECT path, outcome FROM validated"))
def _(t):
    return _validated(t).select("path", "outcome")


@query("import_report", S.with_tables(VALIDATED, select="""
SELECT archive, CAST(count(*) FILTER (outcome = 'ok') AS BIGINT) AS ok, CAST(count(*) FILTER (outcome = 'failed') AS BIGINT) AS failed,
       CAST(count(*) FILTER (outcome = 'empty') AS BIGINT) AS empty FROM validated GROUP BY archive"""))
def _(t):
    return ingest.report(_validated(t))


@query("import_problems", S.with_tables(VALIDATED, select="SELECT archive, path, outcome FROM validated WHERE outcome <> 'ok'"))
def _(t):
    return ingest.problems(_validated(t))


@query("new_checksums", S.with_tables(S.RESOURCES, select="""
SELECT path, md5(text) AS md5 FROM resources JOIN documents USING (doc_id)
WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""))
def _(t):
    docs = t.documents.select("doc_id", "text").join(t.resources.select("doc_id", "path"), "doc_id")
    known = t.resources.join(t.labels.select("doc_id"), "doc_id", "left_semi")
    return ingest.checksums(docs, known)


LOADED = S.PAIRS + r""",
algs AS (SELECT slot || '/u/xml/' || src_lang || '-' || trg_lang || '/' || basename AS path, src_path, trg_path,
    least(src_size, trg_size) AS links, src_lang || '-' || trg_lang AS pair FROM doc_pairs),
new_algs AS (SELECT * FROM algs WHERE links % 2 = 1)"""


def _loaded(t):
    algs = t.doc_pairs.select(
        F.concat_ws("/", "slot", F.lit("u/xml"), F.concat_ws("-", "src_lang", "trg_lang"), "basename").alias("path"),
        "src_path", "trg_path", F.least("src_size", "trg_size").alias("links"))
    docs = t.resources.select("path", F.col("size").alias("sentences"))
    have = algs.where("links % 2 = 0").select("path").unionByName(t.resources.where("doc_id % 9 = 0").select("path"))
    return ingest.load_corpus(algs, docs, have)


@query("load_corpus_tree", S.with_tables(LOADED, select="""
SELECT path, 'sentalign' AS kind, links AS size FROM new_algs UNION ALL
SELECT path, 'corpusfile', size FROM resources WHERE doc_id % 9 <> 0
  AND path IN (SELECT src_path FROM new_algs UNION SELECT trg_path FROM new_algs)"""))
def _(t):
    return _loaded(t)["records"]


@query("loaded_language_pairs", S.with_tables(LOADED, select="SELECT DISTINCT pair FROM new_algs"))
def _(t):
    return _loaded(t)["pairs"]


@query("validate_memories", S.with_tables(S.BITEXT, r"""
files AS (SELECT conv_id % 16 AS file, count(*) FILTER (conv_id % 16 <> 3) AS n FROM bitext GROUP BY 1)""", select="""
SELECT 'm' || file AS file, CASE WHEN file = 3 THEN 'empty' WHEN file % 5 = 1 THEN 'failed' ELSE 'ok' END AS outcome FROM files"""))
def _(t):
    """Translation memories in 16 files: every fifth has units with an open tag, one has none at all."""
    path = scratch(t.spark, "checked")
    no = F.col("conv_id") % 16
    seg = X.escape_xml(X.whitespace(X.clean_xml(F.col("src_text"))))
    unit = F.concat(F.lit('<tu><tuv xml:lang="en"><seg>'), seg, F.when(no % 5 == 1, "</tuv>").otherwise("</seg></tuv>"), F.lit("</tu>"))
    rows = t.bitext.select(F.concat(F.lit("m"), no.cast("string")).alias("file"), "pair_id",
                           F.when(no == 3, "").otherwise(unit).alias("line"))
    writers.write_framed(rows, path, ["pair_id"], F.lit("<tmx><body>"), F.lit("</body></tmx>"))
    out = ingest.validate(readers.checked(t.spark, path, "tu", readers.TU))
    return out.select(F.regexp_extract("path", r"file=([^/]+)/", 1).alias("file"), "outcome")


@query("links_table", S.with_tables(LADDER, select="SELECT pair_id, link_pos, len(src_ids) AS src_n, len(trg_ids) AS trg_n FROM ladder"))
def _(t):
    path = scratch(t.spark, "links")
    writers.links(align.ladder_to_links(_rungs(t)), path)
    return t.spark.read.parquet(path).select("pair_id", "link_pos", F.size("src_ids").cast("bigint").alias("src_n"),
                                             F.size("trg_ids").cast("bigint").alias("trg_n"))


# Files as other programs write them: put together here as plain text, not by this package's writers.

def _shown(c):
    return X.escape_xml(X.clean_xml(c))


FLAT = rf"trim(regexp_replace(%s, '{SPACE}+', ' ', 'g'))"


@query("corpus_xml_other_dialect", S.with_tables(S.LINES, select=f"""
SELECT doc_id || '.' || sent_pos AS sent_id, CASE WHEN sent_pos % 4 <> 0 THEN 'p' || sent_pos END AS para_id,
       CASE WHEN sent_pos % 4 = 1 THEN lang END AS lang, md5({FLAT % 'text'}) AS md5 FROM lines"""))
def _(t):
    """Sentences outside paragraphs, tokens instead of text, single quotes, comments and marked sections."""
    path = scratch(t.spark, "dialect")
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    def sentence(x, i):
        n = F.concat_ws(".", F.col("doc_id").cast("string"), (i + 1).cast("string"))
        words = F.transform(F.filter(F.split(X.whitespace(x), " "), lambda w: w != ""), lambda w: F.concat(F.lit("<w>"), _shown(w), F.lit("</w>")))
        tokens = F.concat(F.lit("<head><s id='"), n, F.lit("'>"), F.array_join(words, ""), F.lit("</s></head>"))
        within = F.when((i + 1) % 4 == 1, F.concat(F.lit("<s lang='"), "lang", F.lit("' id='"), n, F.lit("'><chunk>"), _shown(x), F.lit("</chunk></s>"))).otherwise(
            F.concat(F.lit('<!-- <s id="no">no</s> -->\n<s id="'), n, F.lit('"><![CDATA['), x, F.lit("]]></s>")))
        return F.when((i + 1) % 4 == 0, tokens).otherwise(F.concat(F.lit('<p id="p'), (i + 1).cast("string"), F.lit('">\n'), within, F.lit("\n</p>")))
    t.documents.select(F.concat(F.lit("<text>\n"), F.array_join(F.transform(lines, sentence), "\n"), F.lit("\n</text>"))).write.text(path)
    return readers.corpus_xml(t.spark, path).select("sent_id", "para_id", "lang", F.md5("text").alias("md5"))


@query("xliff_grouped_units", S.with_tables(S.BITEXT, select=rf"""
SELECT pair_id AS original, turn || '' AS unit_id, 'en' AS src_lang, 'fr' AS trg_lang,
       md5({FLAT % "src_text || ' one'"}) AS source, md5({FLAT % "trg_text || ' a<b'"}) AS target FROM bitext"""))
def _(t):
    path = scratch(t.spark, "groups")
    unit = F.concat(F.lit('<file original="'), "pair_id", F.lit('" source-language="eng" target-language="fr-FR"><header/><body><group><group><trans-unit id="'),
                    F.col("turn").cast("string"), F.lit('"><source>'), _shown(F.col("src_text")), F.lit(' <g id="1">one</g></source><target>'),
                    _shown(F.col("trg_text")), F.lit(' <![CDATA[a<b]]></target></trans-unit></group></group></body></file>'))
    t.bitext.select(unit).write.text(path)
    return readers.xliff(t.spark, path).select("original", "unit_id", "src_lang", "trg_lang", F.md5("source").alias("source"), F.md5("target").alias("target"))


@query("memory_with_inline_tags", S.with_tables(S.BITEXT, select=rf"""
SELECT pair_id AS tu_id, 'en' AS lang, md5({FLAT % "src_text || ' {1}bold é'"}) AS md5 FROM bitext
UNION ALL SELECT pair_id, 'fr', md5({FLAT % 'trg_text'}) FROM bitext"""))
def _(t):
    path = scratch(t.spark, "inline")
    unit = F.concat(F.lit("<tu tuid='"), "pair_id", F.lit('\'><tuv xml:lang="en-US"><prop type="x">p</prop><seg>'), _shown(F.col("src_text")),
                    F.lit(' <ph x="1">{1}</ph><bpt i="1"/>bold &#xE9;</seg></tuv>\n<tuv lang="fra"><seg>'), _shown(F.col("trg_text")), F.lit("</seg></tuv></tu>"))
    t.bitext.select(F.concat(F.lit("<!-- <tu><tuv lang='de'><seg>no</seg></tuv></tu> -->"), unit)).write.text(path)
    return readers.tmx(t.spark, path).select("tu_id", "lang", F.md5("seg").alias("md5"))


@query("xml_character_data", rf"""
SELECT doc_id, md5({FLAT % "replace(text, chr(10), ' ') || ' café is x > y <z> & &#65;'"}) AS md5 FROM documents""")
def _(t):
    xml = F.concat(F.lit("<doc><head>left out</head><p>"), _shown(F.replace("text", F.lit("\n"), F.lit(" "))),
                   F.lit(" caf&#233; is <![CDATA[x > y <z> &]]> &amp;#65;</p></doc>"))
    out = readers.xml_segments(t.documents.select("doc_id", xml.alias("text")))
    return out.groupBy("doc_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("seg_pos", "sent_pos", "sentence"))), lambda x: x["sentence"]), " ")).alias("md5"))


@query("subtitle_cues_without_numbers", S.with_tables(S.LINES, select=rf"""
SELECT doc_id, sent_pos * 3.0::DOUBLE AS t_start, md5({FLAT % 'text'}) AS md5 FROM lines"""))
def _(t):
    def stamp(sec):
        return F.format_string("%02d:%02d:%02d,000", F.floor(sec / 3600), F.floor(sec % 3600 / 60), F.floor(sec % 60))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    cues = F.transform(lines, lambda x, i: F.concat(stamp((i + 1) * 3), F.lit(" --> "), stamp((i + 1) * 3 + 2), F.lit("\n"), x, F.lit("\n")))
    files = t.documents.select("doc_id", F.array_join(cues, "\n").alias("text"))
    return readers.srt(files).where("cue is null").select("doc_id", "t_start", F.md5("text").alias("md5"))


# Files in other charsets, and corpus files with all their markup.

# Letters that all western charsets have, and how a Latin text is spelt in Cyrillic letters.
LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувщхыз"
WESTERN = "ÄÖÜäöüßàâçéèêëîïôûùñáíóúÀÉÈÊ"
ENCODABLE = rf"[^ -~{WESTERN}]"
# a line's charset by language and number of its document
CHARSETS = [["windows-1251", "KOI8-R", "IBM866", "UTF-8", "UTF-16LE"], ["windows-1252", "IBM850", "macintosh", "UTF-8", "UTF-16BE"]]
SPELT = f"""
spelt AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'ru' ELSE lang END AS lang, CASE WHEN lang = 'en' THEN translate(lower(regexp_replace(text, '[^ -~]', '', 'g')),
  '{LATIN}', '{CYRILLIC}') ELSE regexp_replace(text, '{ENCODABLE}', '', 'g') END AS text FROM lines)"""


def _spelt(t):
    """Lines of the documents in letters that their charsets have; English in Cyrillic ones."""
    english = F.col("lang") == "en"
    text = F.when(english, F.translate(F.lower(F.regexp_replace("text", "[^ -~]", "")), LATIN, CYRILLIC)).otherwise(F.regexp_replace("text", ENCODABLE, ""))
    return t.sentences.select("doc_id", "sent_pos", F.when(english, "ru").otherwise(F.col("lang")).alias("lang"), text.alias("text"))


@query("charset_by_content", S.with_tables(S.LINES, SPELT, select=f"""
SELECT lang, list_extract(CASE WHEN lang = 'ru' THEN {CHARSETS[0]} ELSE {CHARSETS[1]} END, doc_id % 5 + 1) AS charset, md5(text) AS md5, count(*) AS n
FROM spelt WHERE trim(text) <> '' GROUP BY ALL"""))
def _(t):
    """Files in ten charsets without any mark, told by byte pairs of texts of known language, and their lines."""
    path = scratch(t.spark, "charsets")
    spelt = _spelt(t).where(F.trim("text") != "")
    for k in range(5):
        for some, names in ((F.col("lang") == "ru", CHARSETS[0]), (F.col("lang") != "ru", CHARSETS[1])):
            name = names[k]
            rows = spelt.where(some & (F.col("doc_id") % 5 == k))
            body = rows.select(F.concat_ws("-", "lang", F.lit(str(k))).alias("file"), "text")
            charsets.encoded(body, name, "text").write.partitionBy("file").option("lineSep", "\n").option(
                "encoding", name if name in charsets.UNIVERSAL else "UTF-8").text(f"{path}/{k}/{names.index(name)}-{names[0]}")
    lang = F.regexp_extract("file", r"file=([a-z]+)-", 1)
    found = charsets.of_files(t.spark, path, charsets.train(spelt), lang)
    lines = readers.numbered_lines(t.spark, path, found).join(found, "file")
    return lines.groupBy(lang.alias("lang"), "charset", F.md5("text").alias("md5")).agg(F.count(F.lit(1)).alias("n"))


@query("memories_in_any_charset", S.with_tables(S.BITEXT, select=rf"""
SELECT pair_id AS tu_id, lang, md5(trim(regexp_replace(regexp_replace(seg, '{ENCODABLE}', '', 'g'), '{SPACE}+', ' ', 'g'))) AS md5 FROM (
  SELECT pair_id, 'en' AS lang, src_text AS seg FROM bitext UNION ALL SELECT pair_id, 'fr', trg_text FROM bitext)"""))
def _(t):
    """Translation memories in UTF-16 with and without a mark, and in charsets that only their declaration tells."""
    path = scratch(t.spark, "memories")
    def seg(lang, c):
        return F.concat(F.lit(f'<tuv xml:lang="{lang}"><seg>'), _shown(F.regexp_replace(c, ENCODABLE, "")), F.lit("</seg></tuv>"))
    unit = F.concat(F.lit('<tu tuid="'), "pair_id", F.lit('">'), seg("en", "src_text"), seg("fr", "trg_text"), F.lit("</tu>"))
    heads = [("UTF-16LE", "\ufeff<?xml version='1.0'?>"), ("UTF-16BE", "<?xml version='1.0'?>"), ("windows-1252", "<?xml version='1.0' encoding='ISO-8859-1'?>"),
             ("IBM850", "<?xml version='1.0' encoding='cp850'?>"), ("UTF-8", "\ufeff")]
    for k, (name, head) in enumerate(heads):
        rows = t.bitext.where(F.col("conv_id") % 5 == k).select(writers.bucket("pair_id", 2).alias("file"), "pair_id", unit.alias("line"))
        writers.write_framed(rows, f"{path}/{k}", ["pair_id"], F.lit(head + "<tmx><body>"), F.lit("</body></tmx>"), name)
    return readers.tmx(t.spark, path).select("tu_id", "lang", F.md5("seg").alias("md5"))


def _markup(t):
    """Corpus files of 64 documents with divisions, paragraphs of ten lines, sentences with attributes, some without text."""
    file = F.concat(F.lit("d"), F.floor(F.col("doc_id") / 64).cast("string"))
    rows = t.sentences.withColumn("file", file)
    rows = rows.withColumn("unit_no", F.row_number().over(Window.partitionBy("file").orderBy("doc_id", "sent_pos")).cast("bigint"))
    starts, para, none = F.col("sent_pos") == 1, F.col("sent_pos") % 10 == 1, F.array().cast("array<string>")
    def tags(when, *names):
        return F.when(when, F.array(*names)).otherwise(none)
    first = F.col("unit_no") == 1
    before = F.concat(tags(first, F.lit("<text>")), tags(para & ~first, F.lit("</p>")), tags(starts & ~first, F.lit("</div>")),
                      tags(starts, F.concat(F.lit('<div n="'), F.col("doc_id").cast("string"), F.lit('">'))), tags(para, F.lit("<p>")))
    name = F.concat_ws(".", F.col("doc_id").cast("string"), F.col("sent_pos").cast("string"))
    odd = F.col("sent_pos") % 3 == 0
    attributes = F.when(odd, F.create_map(F.lit("id"), name, F.lit("lang"), "lang", F.lit("n"), F.lit('"&<'))).otherwise(F.create_map(F.lit("id"), name, F.lit("lang"), "lang"))
    text = F.when(F.col("sent_pos") % 7 == 0, "").otherwise(F.col("text"))
    units = rows.select("file", "unit_no", F.lit("<s>").alias("tag"), attributes.alias("attributes"), before.alias("before"), text.alias("text"))
    ends = units.groupBy("file").agg((F.max("unit_no") + 1).alias("unit_no")).select(
        "file", "unit_no", F.lit(None).cast("string").alias("tag"), F.lit(None).cast("map<string,string>").alias("attributes"),
        F.array(*[F.lit(x) for x in ("</p>", "</div>", "</text>")]).alias("before"), F.lit(None).cast("string").alias("text"))
    return units.unionByName(ends)


MARKUP = S.LINES + r""",
placed AS (SELECT 'd' || doc_id // 64 AS file, doc_id, sent_pos, lang, text, row_number() OVER (PARTITION BY doc_id // 64 ORDER BY doc_id, sent_pos) AS unit_no FROM lines)"""


def _written_markup(t):
    def make():
        path = scratch(t.spark, "markup")
        writers.corpus_units(_markup(t), path)
        return readers.corpus_units(t.spark, path).withColumn("file", F.regexp_extract("file", r"file=([^/]+)/", 1))
    return t.written("markup", make)


@query("corpus_markup_round_trip", S.with_tables(MARKUP, select=rf"""
SELECT file, unit_no, 'id=' || doc_id || '.' || sent_pos || ';lang=' || lang || CASE WHEN sent_pos % 3 = 0 THEN ';n="&<' ELSE '' END AS attributes,
  concat(CASE WHEN unit_no = 1 THEN '<text>' END, CASE WHEN sent_pos % 10 = 1 AND unit_no > 1 THEN '</p>' END, CASE WHEN sent_pos = 1 AND unit_no > 1 THEN '</div>' END,
    CASE WHEN sent_pos = 1 THEN '<div n="' || doc_id || '">' END, CASE WHEN sent_pos % 10 = 1 THEN '<p>' END) AS before,
  md5(CASE WHEN sent_pos % 7 = 0 THEN '' ELSE {FLAT % 'text'} END) AS md5 FROM placed
UNION ALL SELECT file, max(unit_no) + 1, NULL, '</p></div></text>', NULL FROM placed GROUP BY file"""))
def _(t):
    """All attributes, empty sentences, the tags before every sentence and after the last one, written and read back."""
    return _written_markup(t).select(
        "file", "unit_no", F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("attributes"),
        F.array_join("before", "").alias("before"), F.md5("text").alias("md5"))


@query("open_elements", S.with_tables(MARKUP, select="""
SELECT file, unit_no, 'text/div ' || doc_id || '/p' AS open FROM placed"""))
def _(t):
    """The elements every sentence stands in, with the number of the division."""
    found = markup.with_open(_written_markup(t)).where(F.col("tag").isNotNull())
    number = F.regexp_extract(F.get("open", F.lit(1)), 'n="([^"]*)"', 1)
    names = F.transform("open", lambda x, i: F.concat(markup.tag_name(x), F.when(i == 1, F.concat(F.lit(" "), number)).otherwise("")))
    return found.select("file", "unit_no", F.array_join(names, "/").alias("open"))


@query("tag_census", S.with_tables(MARKUP, select="""
SELECT file AS doc, tag, n FROM (
  SELECT file, 'text' AS tag, count(*) FILTER (unit_no = 1) AS n FROM placed GROUP BY file
  UNION ALL SELECT file, 'div', count(*) FILTER (sent_pos = 1) FROM placed GROUP BY file
  UNION ALL SELECT file, 'p', count(*) FILTER (sent_pos % 10 = 1) FROM placed GROUP BY file
  UNION ALL SELECT file, 's', count(*) FROM placed GROUP BY file)"""))
def _(t):
    return markup.tag_census(_written_markup(t))


@query("pieces_within_boundaries", S.with_tables(S.PAIRS, r"""
marks AS (SELECT doc_id, unnest(range(1, size + 1)) AS pos, size FROM resources),
tags AS (SELECT doc_id, pos, 'p' AS tag FROM marks WHERE pos % 5 = 1 UNION ALL SELECT doc_id, pos, 'half' FROM marks WHERE pos = size // 2 + 1
  UNION ALL SELECT doc_id, pos, 'head' FROM marks WHERE pos = 1),
census AS (SELECT doc_id, tag, count(*) AS n FROM tags GROUP BY ALL),
best AS (SELECT d.pair_id, d.src_doc, d.trg_doc, a.tag, a.n, row_number() OVER (PARTITION BY d.pair_id ORDER BY a.n DESC, a.tag) AS rn FROM doc_pairs d
  JOIN census a ON a.doc_id = d.src_doc JOIN census b ON b.doc_id = d.trg_doc AND a.tag = b.tag AND a.n = b.n),
cuts AS (SELECT b.pair_id, b.src_doc, b.trg_doc, s.pos AS s, row_number() OVER (PARTITION BY b.pair_id ORDER BY s.pos) AS n FROM best b
  JOIN tags s ON s.doc_id = b.src_doc AND s.tag = b.tag AND s.pos > 1 WHERE rn = 1),
others AS (SELECT b.pair_id, t.pos AS t, row_number() OVER (PARTITION BY b.pair_id ORDER BY t.pos) AS n FROM best b
  JOIN tags t ON t.doc_id = b.trg_doc AND t.tag = b.tag AND t.pos > 1 WHERE rn = 1),
points AS (SELECT pair_id, s, t FROM cuts JOIN others USING (pair_id, n) UNION ALL SELECT pair_id, 1, 1 FROM best WHERE rn = 1),
ended AS (SELECT p.*, d.src_size, d.trg_size FROM points p JOIN doc_pairs d USING (pair_id))""", select="""
SELECT pair_id, s AS src_from, t AS trg_from, lead(s, 1, src_size + 1) OVER w - s AS src_n, lead(t, 1, trg_size + 1) OVER w - t AS trg_n
FROM ended WINDOW w AS (PARTITION BY pair_id ORDER BY s, t)"""))
def _(t):
    """Pairs cut at the structural tag that opens equally often in both texts."""
    sizes = t.sentences.groupBy("doc_id").agg(F.max("sent_pos").alias("size"))
    half = F.floor(F.col("size") / 2) + 1
    tags = F.filter(F.array(F.when(F.col("sent_pos") % 5 == 1, "<p>"), F.when(F.col("sent_pos") == half, "<half>"), F.when(F.col("sent_pos") == 1, "<head/>")),
                    lambda x: x.isNotNull())
    units = t.sentences.join(sizes, "doc_id").select(
        F.col("doc_id").alias("file"), F.col("sent_pos").alias("unit_no"), F.lit("<s>").alias("tag"), tags.alias("before"), "text")
    pairs = t.doc_pairs.select("pair_id", "src_doc", "trg_doc")
    best = align.best_boundary_tag(markup.tag_census(units, None), pairs)
    cut = align.within_boundaries(units, pairs.join(best, "pair_id"))
    return cut.select("pair_id", F.col("src_from").cast("bigint").alias("src_from"), F.col("trg_from").cast("bigint").alias("trg_from"),
                      F.size("src_lens").cast("bigint").alias("src_n"), F.size("trg_lens").cast("bigint").alias("trg_n"))


# Whole jobs on folders of mixed files.

def _name():
    """The name a file was written under: Spark encodes it for the folder, and the folder for its URI."""
    return F.url_decode(F.url_decode(F.regexp_extract("file", r"file=([^/]+)/", 1)))


@query("intake_of_mixed_folder", S.with_tables(S.BITEXT, S.LINES, select="""
SELECT 'm' || conv_id % 3 || '.tmx' AS path, 'tmx' AS format, CAST(2 * count(*) AS BIGINT) AS records, 'ok' AS outcome FROM bitext GROUP BY conv_id % 3
UNION ALL SELECT 'corpus' || doc_id % 4 || '.xml', 'xml', count(*), 'ok' FROM lines GROUP BY doc_id % 4
UNION ALL SELECT 'memory.xml', 'tmx', CAST(2 * count(*) AS BIGINT), 'ok' FROM bitext
UNION ALL SELECT 'moses/lines.en', 'moses', count(*), 'ok' FROM bitext
UNION ALL SELECT 'broken.tmx', NULL, 0, 'failed' UNION ALL SELECT 'empty.xlf', NULL, 0, 'empty'"""))
def _(t):
    """Memories in UTF-16, corpus files, a memory under another suffix, line files, a broken and an empty file, each read by what fits."""
    path = scratch(t.spark, "mixed")
    def seg(lang, c):
        return F.concat(F.lit(f'<tuv xml:lang="{lang}"><seg>'), _shown(F.col(c)), F.lit("</seg></tuv>"))
    unit = F.concat(F.lit('<tu tuid="'), "pair_id", F.lit('">'), seg("en", "src_text"), seg("fr", "trg_text"), F.lit("</tu>"))
    def memory(file, charset):
        writers.write_framed(t.bitext.select(file.alias("file"), "pair_id", unit.alias("line")), f"{path}/{charset}", ["pair_id"],
                             F.lit("\ufeff<tmx><body>"), F.lit("</body></tmx>"), charset)
    memory(F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string"), F.lit(".tmx")), "UTF-16LE")
    memory(F.lit("memory.xml"), "UTF-8")
    corpus = t.sentences.select(F.concat(F.lit("corpus"), (F.col("doc_id") % 4).cast("string"), F.lit(".xml")).alias("file"),
                                F.col("doc_id").cast("string").alias("para_id"), "sent_pos", "lang", "text")
    writers.corpus_xml(corpus, f"{path}/corpus")
    lines = t.bitext.select(F.lit("moses/lines.en").alias("file"), "pair_id", writers.plain_line(F.col("src_text")).alias("line"))
    lines.select("file", "line").write.partitionBy("file").text(f"{path}/lines")
    one = t.spark.createDataFrame([("broken.tmx", "<tmx><tu><tuv><seg>x</tuv></tu></tmx>"), ("empty.xlf", "<xliff></xliff>")], "file string, line string")
    one.write.partitionBy("file").text(f"{path}/bad")
    out = jobs.intake(t.spark, path, lang=F.lit("en"), name=_name())["outcomes"]
    # lines were written in several files of one name
    return out.groupBy("path", "format", "outcome").agg(F.sum("records").alias("records"))


TREE = S.PAIRS + r""",
named AS (SELECT d.*, src_lang || '-' || trg_lang || '/' || slot || '.' || basename AS alg FROM doc_pairs d),
algs AS (SELECT alg, src_lang || ',' || trg_lang AS language, CAST(sum(least(src_size, trg_size)) AS BIGINT) AS size FROM named WHERE src_size > 0 AND trg_size > 0 GROUP BY ALL),
declared AS (SELECT src_doc AS doc FROM named WHERE src_size > 0 AND trg_size > 0 UNION SELECT trg_doc FROM named WHERE src_size > 0 AND trg_size > 0)"""


@query("load_tree_from_files", S.with_tables(TREE, select="""
SELECT 'r/u/xml/' || alg AS path, 'sentalign' AS kind, language, size FROM algs
UNION ALL SELECT 'r/u/xml/' || lang || '/' || doc_id || '.xml', 'corpusfile', lang, size FROM resources JOIN declared ON doc = doc_id WHERE doc_id % 9 <> 0"""))
def _(t):
    """Alignment files and the documents they declare, written as a tree and loaded; every ninth document is in the catalog already."""
    path = scratch(t.spark, "tree")
    def doc(lang, number):
        return F.concat_ws("/", lang, F.concat(F.col(number).cast("string"), F.lit(".xml")))
    named = t.doc_pairs.select("pair_id", F.concat(F.concat_ws("-", "src_lang", "trg_lang"), F.lit("/"), "slot", F.lit("."), "basename").alias("file"),
                         doc("src_lang", "src_doc").alias("src_path"), doc("trg_lang", "trg_doc").alias("trg_path"))
    links = align.one_to_one(t.doc_pairs).where((F.size("src_ids") > 0) & (F.size("trg_ids") > 0)).join(named, "pair_id").select(
        "file", "src_path", "trg_path", "link_pos", F.transform("src_ids", lambda x: x.cast("string")).alias("src_ids"),
        F.transform("trg_ids", lambda x: x.cast("string")).alias("trg_ids"), "score")
    writers.xces(links, f"{path}/a")
    text = t.sentences.select(F.concat_ws("/", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".xml"))).alias("file"), F.lit("1").alias("para_id"),
                              "sent_pos", "lang", "text")
    writers.corpus_xml(text, f"{path}/d")
    known = t.resources.where("doc_id % 9 = 0").select(F.concat(F.lit("r/u/xml/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".xml")).alias("path"))
    m = F.col("meta")
    return jobs.load_tree(t.spark, path, known, "r/u", _name())["records"].select(
        "path", m["resource-type"].alias("kind"), m["language"].alias("language"), m["size"].cast("bigint").alias("size"))
