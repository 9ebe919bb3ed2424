"""Language codes and names.

The code table is taken from the Java runtime's ISO 639 data, not written out here.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bibliographic three-letter codes that differ from the terminological ones.
BIBLIOGRAPHIC = {
    "alb": "sqi", "arm": "hye", "baq": "eus", "bur": "mya", "chi": "zho", "cze": "ces", "dut": "nld",
    "fre": "fra", "geo": "kat", "ger": "deu", "gre": "ell", "ice": "isl", "mac": "mkd", "mao": "mri",
    "may": "msa", "per": "fas", "rum": "ron", "slo": "slk", "tib": "bod", "wel": "cym",
}

# Region used in a language tag when none is given and it is not the language code.
DEFAULT_REGION = {
    "af": "ZA", "cs": "CZ", "da": "DK", "el": "GR", "en": "US", "et": "EE", "ga": "IE", "ja": "JP", "ko": "KR",
    "sl": "SI", "sv": "SE", "uk": "UA", "zh": "CN",
}


@cache
def _iso639(spark: SparkSession) -> tuple[tuple[str, str, str], ...]:
    locale = spark.sparkContext._jvm.java.util.Locale
    found = []
    for two in locale.getISOLanguages():
        entry = locale.forLanguageTag(two)
        if entry.getLanguage() == two:
            found.append((two, entry.getISO3Language(), entry.getDisplayLanguage(locale.ENGLISH)))
    return tuple(sorted(found))


def _rows(spark: SparkSession, rows, columns: str) -> DataFrame:
    """A small literal table that needs no Python worker."""
    quoted = ", ".join("(" + ", ".join("'" + v.replace("'", "\\'") + "'" for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {quoted} AS t({columns})")


def codes(spark: SparkSession) -> DataFrame:
    """``two, three, name``: one row per ISO 639-1 code (fewer than 200 rows)."""
    return _rows(spark, _iso639(spark), "two, three, name")


def code_forms(spark: SparkSession) -> DataFrame:
    """``form, two``: every code or lower-cased name that stands for a language."""
    two_of = {three: two for two, three, _ in _iso639(spark)}
    forms = {b: two_of[t] for b, t in BIBLIOGRAPHIC.items() if t in two_of}
    for two, three, name in _iso639(spark):
        forms |= {two: two, three: two, name.lower(): two}
    return _rows(spark, sorted(forms.items()), "form, two")


def bare(code: Column) -> Column:
    """A language tag without its region, in lower case."""
    return F.lower(F.regexp_replace(code, r"[_-].*$", ""))


def to_two(df: DataFrame, column: str, out: str) -> DataFrame:
    """Any code, tag or English name to two letters; unknown values stay as they are."""
    forms = F.broadcast(code_forms(df.sparkSession)).select(
        F.col("form").alias("_form"), F.col("two").alias("_two"))
    joined = df.withColumn("_bare", bare(F.col(column))).join(forms, F.col("_bare") == F.col("_form"), "left")
    return joined.withColumn(out, F.coalesce("_two", column)).drop("_bare", "_form", "_two")


def with_codes(df: DataFrame, column: str) -> DataFrame:
    """Add ``two``, ``three``, ``name_en`` and ``tag`` (language with region) for a two-letter code."""
    c = F.broadcast(codes(df.sparkSession)).select(
        "two", "three", F.col("name").alias("name_en"))
    region = F.create_map(*[F.lit(x) for kv in DEFAULT_REGION.items() for x in kv])
    given = F.upper(F.regexp_extract(F.col(column), r"[_-](.+)$", 1))
    joined = df.join(c, bare(F.col(column)) == F.col("two"), "left")
    return joined.withColumn("tag", F.concat_ws("_", "two", F.when(given != "", given).otherwise(
        F.coalesce(F.element_at(region, F.col("two")), F.upper("two")))))


def _choice(two: Column, three: Column, name: Column) -> Column:
    """The three ways to write a language, longest first."""
    return F.concat(F.lit("(?:"), F.concat_ws("|", F.lower(name), three, two), F.lit(")"))


def strip_language(text: Column, two: Column, three: Column, name: Column) -> Column:
    """A file name without its language marker and with runs of other signs as one blank.

    A marker stands between non-alphanumerics, begins a path element, or ends the name or the
    part before the suffix.
    """
    lang = _choice(two, three, name)
    edge = r"[\p{L}\p{N}]"
    pattern = F.concat(
        F.lit(rf"(?i)(?<!{edge})"), lang, F.lit(rf"(?!{edge})"),
        F.lit("|(?<![^/])"), lang, F.lit("(?=[^/])"),
        F.lit("|"), lang, F.lit(r"(?=\.[a-z]{2,4}|$)"))
    return F.trim(F.regexp_replace(F.regexp_replace(text, pattern, F.lit("")), r"[^\p{L}\p{N}]+", " "))


def names_language(text: Column, two: Column, three: Column, name: Column) -> Column:
    """Does the file name contain the language's code or name?"""
    low = F.lower(text)
    return low.contains(F.lower(name)) | low.contains(three) | low.contains(two)


def without_last_marker(text: Column, two: Column, three: Column, name: Column) -> Column:
    """The file name without the first occurrence of its longest language marker: name, else three letters, else two."""
    low = F.lower(text)
    out = text
    for form in (two, three, F.lower(name)):
        at = F.position(form, low)
        cut = F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(form), F.length(text)))
        out = F.when(at > 0, cut).otherwise(out)
    return out
