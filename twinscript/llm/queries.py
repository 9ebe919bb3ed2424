"""The registered queries of this folder: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscript.llm import (common, decontaminate, fingerprints, idfiles, licences, lines, mainpart, merkle, near, ngrams, packing, phrases, pii, tokens,
                            toxicity)


def op1_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per piece of every document, with its place in a sequence of 1024 ids."""
    return packing.pack_documents(common.table(spark, sf_dir, "documents"), tokens.default_path())


def op2_score_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: the base score and the model's, learned outside fold 1."""
    docs = common.texts(common.table(spark, sf_dir, "documents"))
    held_out = common.fold("doc_id") == 1
    model = ngrams.train(docs.where(~held_out), spark, least=(1, 1))
    return ngrams.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("bigint").alias("train_tokens"),
        "base_score", "score")


def op3_benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document and benchmark item that it holds."""
    return decontaminate.contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document with its class of copies and near copies."""
    return near.near_duplicates(common.table(spark, sf_dir, "documents"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: counts by kind, and all spans."""
    return pii.spans(common.table(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per page with the text of its article."""
    return mainpart.main_text(common.table(spark, sf_dir, "pages"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: its fingerprint, its edited text's, and their likeness."""
    return fingerprints.next_and_edited(common.table(spark, sf_dir, "documents"))


def op8_write_and_read_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document, read back from the files of ids."""
    return idfiles.write_and_read(spark, common.table(spark, sf_dir, "documents"), tokens.default_path())


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document and licence statement."""
    return licences.licences(common.table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: score, prediction and the nearest examples."""
    docs = common.texts(common.table(spark, sf_dir, "documents"))
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", (common.fold("doc_id") == 0).alias("held_out"), "score", "predicted", "evidence")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language by their score."""
    return phrases.collocations(common.table(spark, sf_dir, "documents"))


def op12_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: its lines, those dropped, and the digest of what stays."""
    return lines.digests(common.table(spark, sf_dir, "documents"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: leaf, roots, the digest of its proof, and whether its row still leads to the root."""
    return merkle.verified(common.table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_pack_documents, op2_score_texts, op3_benchmark_passages, op4_near_duplicates, op5_personal_data, op6_main_text, op7_fingerprints, op8_write_and_read_ids, op9_licences, op10_toxicity,
        op11_collocations, op12_repeated_lines, op13_manifest)}
SQL: dict[str, str] = {"op9_licences": licences.sql(), "op11_collocations": phrases.sql(), "op12_repeated_lines": lines.sql(), "op13_manifest": merkle.sql()}
