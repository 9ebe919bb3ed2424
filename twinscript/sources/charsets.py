"""The charset of files, by their content.

A byte order mark decides, then the XML declaration, then whether all of a file is valid UTF-8 or has zero bytes (UTF-16).
What is left is rated by models of byte pairs, one for each language and charset it is written in, trained on texts
of known language.  Files are read in rows of any size by many tasks; a task sends a row of sums per file, so neither a file
nor a text goes through one task.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from twinscript.session import cut_lineage

# Charsets texts of a language come in, the usual one first.
WESTERN = ["windows-1252", "ISO-8859-15", "IBM850", "macintosh"]
CENTRAL = ["windows-1250", "ISO-8859-2", "IBM852"]
CYRILLIC = ["windows-1251", "KOI8-R", "ISO-8859-5", "IBM866"]
USED = {
    **dict.fromkeys(["sq", "bs", "cs", "pl", "ro", "sr", "hr", "sk", "sl", "hu"], CENTRAL),
    **dict.fromkeys(["bg", "mk", "ru"], CYRILLIC), **dict.fromkeys(["be", "uk"], ["windows-1251", "KOI8-U", "ISO-8859-5", "IBM866"]),
    "el": ["windows-1253", "ISO-8859-7"], "tr": ["windows-1254", "ISO-8859-9"], "he": ["windows-1255", "ISO-8859-8"],
    "ar": ["windows-1256", "ISO-8859-6"], "lv": ["windows-1257", "ISO-8859-13"], "lt": ["windows-1257", "ISO-8859-13"],
    "zh": ["Big5", "GB18030"], "ja": ["Shift_JIS", "EUC-JP"], "ko": ["EUC-KR"],
}
# Names that other libraries do not know these charsets by.
CODECS = {"macintosh": "mac_roman"}
UNIVERSAL = ["UTF-8", "UTF-16LE", "UTF-16BE"]
DECLARED = r"""^\s*<\?xml\s[^>]*?encoding\s*=\s*["']([A-Za-z][A-Za-z0-9._-]*)["']"""
HEAD = 200
PAIRS = 1 << 16
#: A model has 65,536 numbers; all models go to every task.
MOST_MODELS = 512
HELD = 64


def codec(name: str) -> str:
    """The name Python knows a charset by; an error if it knows none."""
    return codecs.lookup(CODECS.get(name, name)).name


def used(lang: str | None) -> list[str]:
    return USED.get(lang or "", WESTERN)


def _pairs(raw: bytes) -> np.ndarray:
    """All pairs of neighbouring bytes of which one is no ASCII sign."""
    data = np.frombuffer(raw, dtype=np.uint8)
    if len(data) < 2:
        return np.zeros(0, np.int64)
    pairs = data[:-1].astype(np.int64) << 8 | data[1:]
    return pairs[(data[:-1] | data[1:]) >= 0x80]


def train(texts: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """``lang, charset, pair, n``: byte pairs of the texts of each language, in each charset it is written in."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (of, name), n in held.items():
                seen = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([of] * len(seen), pa.string()), "charset": pa.array([name] * len(seen), pa.string()),
                                                  "pair": pa.array(seen, pa.int32()), "n": pa.array(n[seen], pa.int64())})
            held.clear()

        for b in batches:
            by_lang: dict[str, list[str]] = {}
            for of, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by_lang.setdefault(of, []).append(value)
            for of, values in by_lang.items():
                joined = "\n".join(values)
                for name in used(of):
                    n = np.bincount(_pairs(joined.encode(codec(name), "ignore")), minlength=PAIRS)
                    held[of, name] = held[of, name] + n if (of, name) in held else n
                if len(held) > HELD:
                    yield from flush()
        yield from flush()

    rows = texts.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(count, "lang string, charset string, pair int, n bigint")
    return counts.groupBy("lang", "charset", "pair").agg(F.sum("n").alias("n"))


def _matrix(models: DataFrame) -> tuple[list[tuple[str, str]], np.ndarray]:
    """Languages and charsets, and how likely each pair is in them, as logarithms."""
    def order(name: tuple[str, str]) -> tuple:
        # of charsets that a file looks the same in, the usual one counts
        return name[0], used(name[0]).index(name[1]) if name[1] in used(name[0]) else len(USED), name[1]
    names = sorted((tuple(r) for r in models.select("lang", "charset").distinct().limit(MOST_MODELS + 1).collect()), key=order)
    if len(names) > MOST_MODELS:
        raise ValueError(f"more than {MOST_MODELS} models of languages and charsets")
    place = {name: i for i, name in enumerate(names)}
    counts = np.zeros((len(names), PAIRS), dtype=np.float64)
    for r in models.select("lang", "charset", "pair", "n").toLocalIterator():
        counts[place[r["lang"], r["charset"]], r["pair"]] = r["n"]
    counts += 0.5
    return names, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def rows_of_bytes(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, id, value``: files cut at line feeds, as they are."""
    return spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")


@F.pandas_udf(StringType())
def _known(names: pd.Series) -> pd.Series:
    """The names of charsets, missing where there is no such charset."""
    def name(value: str | None) -> str | None:
        try:
            return value and codec(value) and value
        except LookupError:
            return None
    return names.map(name)


def _marked(rows: DataFrame) -> DataFrame:
    """``file, charset``, missing where neither a mark, a declaration, nor the bytes as such tell."""
    zero = F.lit("\0")
    def times(sign: str) -> Column:
        return (F.octet_length("value") - F.octet_length(F.replace("value", F.lit(sign), F.lit("")))) / 2
    head = F.when(F.col("block") == 0, F.struct("id", F.substring(F.col("value").cast("binary"), 1, HEAD).alias("b")))
    found = rows.groupBy("file").agg(
        F.min_by(head["b"], head["id"]).alias("b"), F.bool_and(F.is_valid_utf8("value")).alias("valid"),
        F.bool_or(F.col("value").contains(zero)).alias("zeros"),
        F.sum(times(" \0") + F.col("value").startswith(zero).cast("int")).alias("little"), F.sum(times("\0 ") + F.col("value").endswith(zero).cast("int")).alias("big"))
    start = F.hex("b")
    name = _known(F.nullif(F.regexp_extract(F.decode(F.coalesce("b", F.lit(b"")), "ISO-8859-1"), DECLARED, 1), F.lit("")))
    sixteen = F.when(start.rlike("^00(?!00)"), "UTF-16BE").when(start.rlike("^(?!00)..00"), "UTF-16LE").when(
        F.col("big") > F.col("little"), "UTF-16BE").otherwise("UTF-16LE")
    bytewise = ~F.upper(name).startswith("UTF")
    return found.select("file", F.when(start.startswith("EFBBBF"), "UTF-8").when(start.startswith("FFFE"), "UTF-16LE").when(
        start.startswith("FEFF"), "UTF-16BE").when(F.col("zeros"), sixteen).when(bytewise, name).when(F.col("valid"), "UTF-8").alias("charset"))


def _rated(rows: DataFrame, models: DataFrame) -> DataFrame:
    """``file, charset`` of ``file, lang, value`` by the model that finds its byte pairs likeliest, among those of its language if that has any."""
    shared = rows.sparkSession.sparkContext.broadcast(_matrix(models))

    def rate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = shared.value
        of_lang: dict[str | None, list[int]] = {}
        for i, (lang, _) in enumerate(names):
            of_lang.setdefault(lang, []).append(i)
        everything = list(range(len(names)))
        for b in batches:
            files, langs, values = (b.column(i).to_pylist() for i in range(3))
            parts: dict[tuple[str, str | None], list[bytes]] = {}
            for file, lang, value in zip(files, langs, values, strict=True):
                parts.setdefault((file, lang), []).append(value)
            out: list[tuple[str, int, int, float]] = []
            for (file, lang), of in parts.items():
                raw = b"\n".join(of)
                pair, n = np.unique(_pairs(raw), return_counts=True)
                chosen = of_lang.get(lang, everything)
                for i, score in zip(chosen, table[np.ix_(chosen, pair)].astype(np.float64) @ n, strict=True):
                    out.append((file, i, raw.decode(codec(names[i][1]), "replace").count("\ufffd"), float(score)))
            yield pa.RecordBatch.from_pydict({
                "file": pa.array([o[0] for o in out], pa.string()), "model": pa.array([o[1] for o in out], pa.int32()),
                "broken": pa.array([o[2] for o in out], pa.int64()), "score": pa.array([o[3] for o in out], pa.float64())})

    rated = rows.mapInArrow(rate, "file string, model int, broken bigint, score double")
    sums = rated.groupBy("file", "model").agg(F.sum("broken").alias("broken"), F.sum("score").alias("score"))
    best = sums.groupBy("file").agg(F.min(F.struct("broken", (-F.round("score", 6)).alias("cost"), "model")).alias("best"))
    return best.select("file", F.element_at(F.array(*[F.lit(name) for _, name in shared.value[0]]), F.col("best.model") + 1).alias("charset"))


def usual(lang: Column) -> Column:
    """The charset texts of a language usually come in if they are not in Unicode."""
    out = None
    for name in sorted({names[0] for names in USED.values()}):
        of = [code for code, names in USED.items() if names[0] == name]
        out = F.when(lang.isin(of), name) if out is None else out.when(lang.isin(of), name)
    return out.otherwise(WESTERN[0])


def of_files(spark: SparkSession, path: str, models: DataFrame | None = None, lang: Column | None = None) -> DataFrame:
    """``file, charset`` of all files below a path; ``lang`` may use the column ``file``.

    Files that neither tell their charset nor are Unicode are rated by ``models``; without these, or where a language has none and
    nothing else is known, they count as written in the language's usual charset.
    """
    code = F.lit(None).cast("string") if lang is None else lang
    found = cut_lineage(_marked(rows_of_bytes(spark, path)))
    named = found.where(F.col("charset").isNotNull())
    rest = found.where(F.col("charset").isNull()).select("file")
    if models is None:
        return named.unionByName(rest.select("file", usual(code).alias("charset")))
    if rest.isEmpty():
        return named
    rows = rows_of_bytes(spark, path).join(rest, "file").select("file", code.alias("lang"), F.col("value").cast("binary").alias("value"))
    rated = rest.join(_rated(rows, models), "file", "left").select("file", F.coalesce("charset", usual(code)).alias("charset"))
    return cut_lineage(named.unionByName(rated))


def decoded(rows: DataFrame, native: bool) -> DataFrame:
    """``rows`` with the bytes in ``value`` as text in Unicode, by their ``charset``, without a byte order mark; signs that are none become U+FFFD.

    ``native`` says that all charsets are Unicode's; then no row leaves the JVM.
    """
    raw = F.col("value").cast("binary")
    if native:
        text = F.when(F.col("charset") == "UTF-16LE", F.decode(raw, "UTF-16LE")).when(
            F.col("charset") == "UTF-16BE", F.decode(raw, "UTF-16BE")).otherwise(F.col("value"))
        return rows.withColumn("value", F.regexp_replace(text, "^\ufeff", ""))
    columns = rows.columns
    place, name = columns.index("value"), columns.index("charset")

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(name).to_pylist()
            texts = [v if v is None else v.decode(codec(c), "replace").removeprefix("\ufeff")
                     for v, c in zip(b.column(place).to_pylist(), names, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == place else b.column(i) for i in range(b.num_columns)], columns)

    schema = ", ".join(f"`{c}` {'string' if c == 'value' else kind}" for c, kind in rows.dtypes)
    return rows.withColumn("value", raw).mapInArrow(decode, schema)


def encoded(rows: DataFrame, charset: str, column: str = "line") -> DataFrame:
    """``rows`` with the text in ``column`` as bytes of a charset, for writers of text; signs it lacks become question marks."""
    columns, place = rows.columns, rows.columns.index(column)
    if charset in UNIVERSAL:
        return rows.withColumn(column, F.encode(column, charset).cast("string"))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [None if t is None else t.encode(codec(charset), "replace") for t in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()) if i == place else b.column(i) for i in range(b.num_columns)], columns)

    schema = ", ".join(f"`{c}` {'binary' if c == column else kind}" for c, kind in rows.dtypes)
    return rows.mapInArrow(encode, schema).withColumn(column, F.col(column).cast("string"))


def text_rows(spark: SparkSession, path: str, sep: str | None, charsets: DataFrame | None = None) -> DataFrame:
    """``file, block, id, value``: files in any charset cut at ``sep`` (at line ends if missing), as text in Unicode.

    ``id`` ascends within a block.  A folder is read once for all charsets that write ``sep`` as ASCII does, and
    once more for each kind of UTF-16 it holds.
    """
    charsets = of_files(spark, path) if charsets is None else charsets
    kinds = {r[0] for r in charsets.select(F.when(F.col("charset").isin(UNIVERSAL), F.col("charset")).otherwise("other").alias("k")).distinct().collect()}

    def read(cut: str | None, encoding: str | None) -> DataFrame:
        reader = spark.read.option("recursiveFileLookup", "true")
        reader = reader.option("lineSep", cut) if cut else reader
        reader = reader.option("encoding", encoding) if encoding else reader
        return reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                        F.monotonically_increasing_id().alias("id"), "value")

    plain = read(sep, None)
    if kinds <= {"UTF-8"}:
        return plain.withColumn("value", F.when(F.col("block") == 0, F.regexp_replace("value", "^﻿", "")).otherwise(F.col("value")))
    parts = [plain.join(charsets.where(~F.col("charset").isin("UTF-16LE", "UTF-16BE")), "file")]
    for name in ("UTF-16LE", "UTF-16BE"):
        if name in kinds:
            parts.append(read(sep or "\n", name).join(charsets.where(F.col("charset") == name), "file"))
    out = decoded(parts[0], "other" not in kinds)
    for part in parts[1:]:
        text = decoded(part, True)
        out = out.unionByName(text if sep else text.withColumn("value", F.regexp_replace("value", "\r$", "")))
    return out.select("file", "block", "id", "value")


def whole_texts(spark: SparkSession, path: str, charsets: DataFrame | None = None) -> DataFrame:
    """``file, value``: a row per file in any charset."""
    charsets = of_files(spark, path) if charsets is None else charsets
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return decoded(files.join(charsets, "file"), charsets.where(~F.col("charset").isin(UNIVERSAL)).isEmpty()).select("file", "value")
