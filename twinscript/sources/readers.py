"""Corpus formats as DataFrames.  Every reader names its schema, so no file is read to infer one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinscript.functions import lang as L
from twinscript.functions import paths
from twinscript.functions import text as X
from twinscript.session import cut_lineage
from twinscript.sources import charsets as C
from twinscript.sources import markup as M

LINK_GROUP = ("_fromDoc string, _toDoc string, "
              "link array<struct<_id: string, _xtargets: string, _certainty: double>>")


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return (spark.read.format("xml").option("rowTag", tag).option("recursiveFileLookup", "true")
            .schema(schema).load(path))


def _file() -> Column:
    return F.col("_metadata.file_path")


def _xml_texts(spark: SparkSession, path: str, tag: str, charsets: DataFrame | None = None) -> DataFrame:
    """``file, record``: the text of each element of a name, read by its end tag, so that many tasks share a file."""
    rows = C.text_rows(spark, path, f"</{tag}>", charsets).select("file", _without_comments(_cdata_escaped(F.col("value"))).alias("value"))
    found = rows.select("file", F.regexp_extract("value", rf"(?s)^(.*?)<{tag}\b", 1).alias("_before"),
                        F.regexp_extract("value", rf"(?s)(<{tag}\b.*)$", 1).alias("record"))
    # an element within a comment follows a comment's beginning that has no end
    return found.where((F.col("record") != "") & ~F.col("_before").contains("<!--")).select(
        "file", F.concat("record", F.lit(f"</{tag}>")).alias("record"))


def whole_files(spark: SparkSession, path: str, charsets: DataFrame | None = None) -> DataFrame:
    """``file, text``: one row per file, plain or gzip, in any charset."""
    return C.whole_texts(spark, path, charsets).select("file", F.col("value").alias("text"))


def plain_text(spark: SparkSession, path: str, lang: Column, method: str = "rules", charsets: DataFrame | None = None) -> DataFrame:
    """Text files as numbered sentences; ``lang`` may use the column ``file``."""
    return X.read_text(whole_files(spark, path, charsets).withColumn("lang", lang), method=method)


def numbered_lines(spark: SparkSession, path: str, charsets: DataFrame | None = None) -> DataFrame:
    """``file, line_no, text`` for files of any size and charset.

    A file is read in blocks by many tasks.  Within a block rows keep their order, so a line's
    number is its place in the block plus the lines of the blocks before; only one row per block
    is gathered to add those up.  How files are cut into blocks depends on settings and on the cores that
    are alive, so lines are stored with their block once, and all numbers come from that one reading.
    """
    lines = cut_lineage(C.text_rows(spark, path, None, charsets).select(
        "file", F.col("block").alias("_block"), F.col("id").alias("_id"), F.col("value").alias("text")))
    blocks = lines.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return lines.join(starts, ["file", "_block"]).select(
        "file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line_no"), "text")


#: What a unit of a translation memory must have to count.
TU = "tuv array<struct<`_xml:lang`: string, _lang: string, seg: string>>, _tuid string"


def checked(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """``path, records, broken`` per file: how many records it holds and whether any is malformed.

    A record counts if the first field of the schema is there.

    Files are listed apart from their content, so that a file without records shows up as well;
    ``ingest.validate`` turns this into outcomes.
    """
    rows = (spark.read.format("xml").option("rowTag", tag).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_broken").option("recursiveFileLookup", "true")
            .schema(f"{schema}, _broken string").load(path))
    found = rows.select(_file().alias("path"), F.col("_broken").isNotNull().alias("bad"),
                        F.col(f"`{rows.columns[0]}`").isNotNull().alias("full")).groupBy("path").agg(
        F.count_if(F.col("full") & ~F.col("bad")).alias("records"), F.max("bad").alias("broken"))
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .select(_file().alias("path")))
    return files.join(found, "path", "left").select(
        "path", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("broken", F.lit(False)).alias("broken"))


def slice_lines(lines: DataFrame, first: int, last: int, number: str = "line_no") -> DataFrame:
    """Lines ``first`` to ``last`` of each resource, by the line number the rows carry."""
    return lines.where(F.col(number).between(first, last))


def moses(lines: DataFrame, first: str, *others: str) -> DataFrame:
    """Line-parallel files ``base.lang`` as ``base, line_no`` and one column per language.

    Line numbers are matched; the first language decides how many there are.
    """
    named = lines.withColumn("lang", F.regexp_extract("file", r"\.([^./]+)$", 1)).withColumn(
        "base", F.regexp_replace("file", r"\.[^./]+$", ""))
    def side(code: str) -> DataFrame:
        return named.where(F.col("lang") == code).select("base", "line_no", F.col("text").alias(code))
    out = side(first)
    for code in others:
        out = out.join(side(code), ["base", "line_no"], "left")
    return out


def _pieces(c: Column, element: str) -> Column:
    """All elements of a name in the text of a file that holds no element of that name within another."""
    return F.regexp_extract_all(c, F.lit(rf"(?s)(<{element}\b[^>]*?(?:/>|>.*?</{element}\s*>))"), F.lit(1))


def _attribute(c: Column, name: str) -> Column:
    """An attribute of the first tag in ``c``, null if it has none."""
    tag = F.regexp_extract(c, r"^<[^>]*>", 0)
    value = F.regexp_extract(tag, rf"""\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)')""", 1)
    other = F.regexp_extract(tag, rf"\s{name}\s*=\s*'([^']*)'", 1)
    found = F.coalesce(F.nullif(value, F.lit("")), F.nullif(other, F.lit("")))
    return F.when(found.isNotNull(), unescape(found))


def _inner(c: Column) -> Column:
    """What stands between an element's tags."""
    return F.regexp_replace(F.regexp_replace(c, r"(?s)^<[^>]*>", ""), r"(?s)</[^>]*>\s*$", "")


def _plain(c: Column) -> Column:
    """Text without tags, its white space made single blanks, entities decoded; a token's end ends a word."""
    return X.whitespace(unescape(F.regexp_replace(F.regexp_replace(c, r"</w\s*>", " "), r"<[^>]*>", "")))


def _without_comments(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<!--.*?-->|<\?.*?\?>", "")


def _cdata_escaped(c: Column) -> Column:
    """Marked sections of character data written with entities instead."""
    parts = F.split(c, r"(?=<!\[CDATA\[)|(?<=\]\]>)")
    plain = F.transform(parts, lambda p: F.when(p.startswith("<![CDATA["), X.escape_xml(F.regexp_replace(
        F.regexp_replace(p, r"^<!\[CDATA\[", ""), r"\]\]>$", ""))).otherwise(p))
    return F.when(c.contains("<![CDATA["), F.array_join(plain, "")).otherwise(c)


def tmx(spark: SparkSession, path: str, charsets: DataFrame | None = None) -> DataFrame:
    """``file, tu_id, lang, seg``: the segments of a translation memory in any charset; languages in two letters.

    Inline tags are left out of a segment, the text in them is not.
    """
    units = _xml_texts(spark, path, "tu", charsets).select("file", F.explode(_pieces(F.col("record"), "tu")).alias("u")).select(
        "file", _attribute(F.col("u"), "tuid").alias("tu_id"), F.explode(_pieces(F.col("u"), "tuv")).alias("v"))
    named = units.select("file", "tu_id", F.coalesce(_attribute(F.col("v"), "xml:lang"), _attribute(F.col("v"), "lang")).alias("_code"),
                         _plain(_inner(F.get(_pieces(F.col("v"), "seg"), F.lit(0)))).alias("seg"))
    return L.to_two(named, "_code", "lang").select("file", "tu_id", F.lower("lang").alias("lang"), "seg")


def xliff(spark: SparkSession, path: str, charsets: DataFrame | None = None) -> DataFrame:
    """``file, original, unit_id, src_lang, trg_lang, source, target``.

    Units count at any depth of groups, their alternatives do not; languages are in two letters; inline tags are left out, their text is not.
    """
    files = _xml_texts(spark, path, "file", charsets).select("file", F.explode(_pieces(F.col("record"), "file")).alias("f"))
    units = files.select("file", _attribute(F.col("f"), "original").alias("original"), _attribute(F.col("f"), "source-language").alias("_src"),
                         _attribute(F.col("f"), "target-language").alias("_trg"), F.explode(_pieces(F.regexp_replace("f", r"(?s)<alt-trans\b.*?</alt-trans\s*>", ""), "trans-unit")).alias("u"))
    def part(name: str) -> Column:
        return _plain(_inner(F.get(_pieces(F.col("u"), name), F.lit(0))))
    named = units.select("file", "original", _attribute(F.col("u"), "id").alias("unit_id"), "_src", "_trg",
                         part("source").alias("source"), part("target").alias("target"))
    coded = L.to_two(L.to_two(named, "_src", "src_lang"), "_trg", "trg_lang")
    return coded.select("file", "original", "unit_id", F.lower("src_lang").alias("src_lang"), F.lower("trg_lang").alias("trg_lang"), "source", "target")


def xces(spark: SparkSession, path: str) -> DataFrame:
    """``file, src_path, trg_path, link_pos, src_ids, trg_ids, score`` of alignment files."""
    groups = _xml(spark, path, "linkGrp", LINK_GROUP).select(
        _file().alias("file"), F.col("_fromDoc").alias("src_path"), F.col("_toDoc").alias("trg_path"),
        F.posexplode("link").alias("_p", "l"))
    def ids(i: int) -> Column:
        side = F.get(F.split("l._xtargets", r"\s*;\s*"), F.lit(i))
        return F.filter(F.split(side, r"\s+"), lambda x: x != "")
    return groups.select("file", "src_path", "trg_path", (F.col("_p") + 1).alias("link_pos"),
                         ids(0).alias("src_ids"), ids(1).alias("trg_ids"), F.col("l._certainty").alias("score"))


def corpus_units(spark: SparkSession, path: str, charsets: DataFrame | None = None) -> DataFrame:
    """All sentences of corpus files with their structure, see ``markup.units``; ``writers.corpus_units`` writes them back."""
    return M.units(spark, path, lambda c: _without_comments(_cdata_escaped(c)), unescape, _plain, charsets)


def corpus_xml(spark: SparkSession, path: str, charsets: DataFrame | None = None) -> DataFrame:
    """``file, para_id, sent_id, lang, text, attributes, before`` of corpus files in any charset.

    Sentences count wherever they stand, with or without text; ``para_id`` is that of the paragraph around one, if any.  Tokens are set apart
    by blanks, other tags within a sentence are left out.  A sentence without an id gets its number in the file;
    one in a comment is none.  ``attributes`` has all of its tag's, ``before`` the tags since the sentence before.

    The paragraph that is open is carried on within a segment of sentences; from segment to segment by one row each.
    """
    found = corpus_units(spark, path, charsets).where(F.col("tag").isNotNull()).withColumn(
        "segment", F.floor((F.col("unit_no") - 1) / M.SEGMENT))
    marks = F.filter("before", lambda t: t.rlike(r"^</?p[\s/>]"))
    marked = cut_lineage(found.withColumn("mark", F.when(F.size(marks) > 0, F.element_at(marks, -1))))
    ends = marked.groupBy("file", "segment").agg(F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("unit_no"))).alias("last"))
    line = Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("file", "segment", F.last("last", ignorenulls=True).over(line).alias("carried"))
    here = Window.partitionBy("file", "segment").orderBy("unit_no").rowsBetween(Window.unboundedPreceding, 0)
    para = F.coalesce(F.last("mark", ignorenulls=True).over(here), F.col("carried"))
    known = marked.join(carried, ["file", "segment"]).withColumn("para", para)
    # an empty paragraph is over where it begins
    return known.select("file", F.when(~F.col("para").endswith("/>"), _attribute(F.col("para"), "id")).alias("para_id"),
                        F.coalesce(F.nullif(F.col("attributes")["id"], F.lit("")), F.col("unit_no").cast("string")).alias("sent_id"),
                        F.nullif(F.col("attributes")["lang"], F.lit("")).alias("lang"), "text", "attributes", "before")


def corpus_dir(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """All sentences below a folder, and how many each file holds."""
    sentences = corpus_xml(spark, path)
    return sentences, sentences.groupBy("file").agg(F.count(F.lit(1)).alias("records"))


# Entities of XML text.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}
NUMERIC = r"^&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});$"


def _numeric(c: Column) -> Column:
    """Entities by code point as their signs."""
    digits = F.regexp_extract(c, r"^&#[xX]?([0-9a-fA-F]+);$", 1)
    code = F.when(F.lower(c).startswith("&#x"), F.upper(digits)).otherwise(F.conv(digits, 10, 16))
    value = F.conv(code, 16, 10).cast("bigint")
    sign = F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")
    return F.when((value > 0) & (value < 0x110000) & ~value.between(0xD800, 0xDFFF), sign).otherwise(c)


def unescape(c: Column) -> Column:
    parts = F.transform(F.split(c, r"(?=&#)|(?<=;)"), lambda p: F.when(p.rlike(NUMERIC), _numeric(p)).otherwise(p))
    c = F.when(c.contains("&#"), F.array_join(parts, "")).otherwise(c)
    for entity, sign in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return c


def xml_segments(docs: DataFrame, text: str = "text", lang: Column | None = None) -> DataFrame:
    """Any XML: the text between two tags is a segment, ``head`` is kept out, segments are split."""
    keys = [c for c in docs.columns if c != text]
    body = F.regexp_replace(_cdata_escaped(F.col(text)), r"(?s)<!--.*?-->|<\?.*?\?>|<!\[?[A-Z].*?>|<head\b.*?</head>", "")
    pieces = F.filter(F.transform(F.split(body, "<[^>]+>"), lambda x: X.whitespace(unescape(x))), lambda x: x != "")
    language = F.lit("en") if lang is None else lang
    return docs.select(*keys, F.posexplode(pieces).alias("_p", "segment")).select(
        *keys, (F.col("_p") + 1).alias("seg_pos"),
        F.posexplode(X.split_sentences(F.col("segment"), language)).alias("_s", "sentence")).select(
        *keys, "seg_pos", (F.col("_s") + 1).alias("sent_pos"), "sentence")


CUE = r"(?s)^\s*(?:(\d+)\s*\n)?([0-9:,]+) --> ([0-9:,]+)[^\n]*\n(.*)$"


def srt(docs: DataFrame, text: str = "text") -> DataFrame:
    """Subtitle cues: number (missing where the file has none), start and end in seconds, cleaned text."""
    keys = [c for c in docs.columns if c != text]
    lines = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    cues = docs.select(*keys, F.explode(F.split(lines, r"\n[ \t]*\n\s*")).alias("_cue")).where(
        F.col("_cue").rlike(CUE))
    part = [F.regexp_extract("_cue", CUE, i) for i in (1, 2, 3, 4)]
    return cues.select(*keys, F.nullif(part[0], F.lit("")).cast("int").alias("cue"), X.seconds(part[1]).alias("t_start"),
                       X.seconds(part[2]).alias("t_end"),
                       X.whitespace(X.clean_cue(part[3])).alias("text"))


def srt_files(spark: SparkSession, path: str, lang: Column | None = None, charsets: DataFrame | None = None) -> DataFrame:
    """Cues of subtitle files, cut into sentences if ``lang`` says in which language."""
    cues = srt(whole_files(spark, path, charsets))
    if lang is None:
        return cues
    return cues.withColumn("lang", lang).select("file", "cue", "t_start", "t_end", F.posexplode(
        X.split_sentences(F.col("text"), F.col("lang"))).alias("_p", "text")).withColumn("sent_pos", F.col("_p") + 1).drop("_p")


# Byte order marks, and the charset of texts that are not UTF-8, by language; windows-1252 for all others.
CHARSETS = {
    "windows-1250": ["sq", "bs", "cs", "pl", "ro", "sr", "hr", "sk", "sl", "hu"],
    "windows-1251": ["bg", "mk", "ru", "be", "uk"], "windows-1253": ["el"], "windows-1254": ["tr"],
    "windows-1255": ["he"], "windows-1256": ["ar"], "windows-1257": ["lv", "lt"], "ISO-8859-4": ["is"],
}


JAVA_CHARSETS = "spark.sql.legacy.javaCharsets"


def charset(content: Column, lang: Column) -> Column:
    """Charset by byte order mark, then UTF-8 if valid, then the language's usual one."""
    head = F.hex(F.substring(content, 1, 3))
    out = (F.when(head.startswith("EFBBBF"), "UTF-8").when(head.startswith("FFFE"), "UTF-16LE")
           .when(head.startswith("FEFF"), "UTF-16BE").when(F.is_valid_utf8(content.cast("string")), "UTF-8"))
    for name, langs in CHARSETS.items():
        out = out.when(lang.isin(langs), name)
    return out.otherwise("windows-1252")


def decode_text(files: DataFrame, content: str = "content", lang: str = "lang") -> DataFrame:
    """Add ``charset`` and ``text`` (without byte order mark) to rows of bytes.

    Charsets beyond the Unicode ones need a session setting while the plan is made; it is put back afterwards.
    """
    conf = files.sparkSession.conf
    before = conf.get(JAVA_CHARSETS, None)
    conf.set(JAVA_CHARSETS, "true")
    try:
        named = files.withColumn("charset", charset(F.col(content), F.col(lang)))
        text = None
        for name in ["UTF-8", "UTF-16LE", "UTF-16BE", *CHARSETS, "windows-1252"]:
            value = F.decode(content, name)
            text = F.when(F.col("charset") == name, value) if text is None else text.when(F.col("charset") == name, value)
        out = named.withColumn("text", F.regexp_replace(text, "^\ufeff", ""))
        out.schema  # analysed here, with the setting
        return out
    finally:
        if before is None:
            conf.unset(JAVA_CHARSETS)
        else:
            conf.set(JAVA_CHARSETS, before)


_READERS: dict[str, Callable[..., DataFrame]] = {
    "tmx": tmx, "xliff": xliff, "xces": xces, "xml": corpus_xml,
    "moses": numbered_lines, "text": whole_files, "srt": srt_files,
}


def register(name: str, fn: Callable[..., DataFrame]) -> None:
    """Add a reader (session, path) → DataFrame."""
    _READERS[name] = fn


def read(spark: SparkSession, fmt: str, path: str) -> DataFrame:
    return _READERS[fmt](spark, path)
