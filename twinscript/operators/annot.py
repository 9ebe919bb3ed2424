"""Annotated tokens: positions, dependency heads and row text per sentence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ["pos", "word", "lemma", "upos", "xpos", "feats", "head_pos", "deprel", "deps", "misc"]


def positions(sentences: DataFrame, toks: str = "tokens") -> DataFrame:
    """One row per token with its position from 1."""
    keys = [c for c in sentences.columns if c != toks]
    return sentences.select(*keys, F.posexplode(toks).alias("_p", "word")).select(
        *keys, (F.col("_p") + 1).alias("pos"), "word")


def resolve_heads(tokens: DataFrame, sent: str = "sent_id") -> DataFrame:
    """Each token's head as a position in its sentence; the root's head is 0.

    The join is on the token's own id within the sentence, a unique key.
    """
    heads = tokens.select(sent, F.col("token_id").alias("head"), F.col("pos").alias("_hp"))
    joined = tokens.join(heads, [sent, "head"], "left")
    return joined.withColumn("head_pos", F.when(F.col("head") == "0", F.lit(0)).otherwise(F.col("_hp"))).drop("_hp")


def conllu(tokens: DataFrame, sent: str = "sent_id") -> DataFrame:
    """Each sentence as lines of ten tab-separated columns, ``_`` for what is missing."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("_")) if c in tokens.columns else F.lit("_") for c in FIELDS]
    lines = tokens.select(sent, "pos", F.concat_ws("\t", *cols).alias("line"))
    return lines.groupBy(sent).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("conllu"))


def raw_text(tokens: DataFrame, sent: str = "sent_id") -> DataFrame:
    """Each sentence as plain text; ``SpaceAfter=No`` in ``misc`` leaves the blank out."""
    gap = F.when(F.col("misc").contains("SpaceAfter=No"), "").otherwise(" ")
    piece = F.struct("pos", F.concat(F.col("word"), F.coalesce(gap, F.lit(" "))).alias("w"))
    return tokens.groupBy(sent).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(piece)), lambda x: x["w"]), "").alias("text"))
