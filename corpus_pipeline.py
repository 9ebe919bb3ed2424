"""From raw documents to packed training sequences, one stored table after each stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from twinscript.llm import common, decontaminate, near, packing, pii, tokens, toxicity
from twinscript.session import cut_lineage


def _small_batches(spark: SparkSession) -> None:
    """Rows reach Python a thousand at a time: the workers live through all stages, beside their executor's heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; labels are learned outside the held-out fold."""
    _small_batches(spark)
    model = toxicity.train(common.texts(docs), common.table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, model)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies, that of the smallest id."""
    _small_batches(spark)
    return near.without_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    _small_batches(spark)
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and the terms that give it away replaced in their texts."""
    _small_batches(spark)
    return pii.sanitised(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents cut into pieces, each with its place in a sequence of 1024 ids."""
    _small_batches(spark)
    return packing.pack_documents(docs, tokens.default_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic), ("near_duplicates", without_copies), ("decontamination", without_benchmark),
    ("personal_data", without_personal_data), ("packing", packed)]

#: The stages learn from the corpus and encode texts, which SQL cannot express; tests use plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
