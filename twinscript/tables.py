"""The given tables and the corpus tables derived from them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscript.operators import catalog, match
from twinscript.operators.numbering import number_rows, plain
from twinscript.session import scratch

_WRITTEN: dict[tuple[str, str, str], str] = {}


class Tables:
    """Lazily opened tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def texts(self, name: str) -> DataFrame:
        """A table with long texts, spread over all cores when its files make fewer tasks.

        Text rules are bound by the processor; a table of many files is used as it is split.
        """
        df = self.read(name)
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

    def written(self, name: str, make) -> DataFrame:
        """``make()`` stored once per application in the shared folder and read back."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _WRITTEN:
            path = scratch(self.spark, name)
            make().write.parquet(path)
            _WRITTEN[key] = path
        return self.spark.read.parquet(_WRITTEN[key])

    @cached_property
    def documents(self) -> DataFrame:
        return self.texts("documents")

    @cached_property
    def labels(self) -> DataFrame:
        return self.read("labels")

    @cached_property
    def pages(self) -> DataFrame:
        return self.texts("pages")

    @cached_property
    def conversations(self) -> DataFrame:
        return self.texts("conversations")

    @cached_property
    def benchmark(self) -> DataFrame:
        return self.read("benchmark")

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events")

    @cached_property
    def resources(self) -> DataFrame:
        """One row per document with the path it has in the corpus tree.

        Only narrow columns are sorted for the numbering; texts never leave the scan.
        """
        return self.written("resources", self._make_resources)

    def _make_resources(self) -> DataFrame:
        narrow = self.documents.select(
            "doc_id", "lang", F.col("source").alias("slot"),
            F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).cast("bigint").alias("size"))
        n = plain(number_rows(narrow, order=["doc_id"], group=["slot", "lang"], name="nr"))
        marker = (F.when(F.col("doc_id") % 3 == 0, F.col("lang"))
                  .when(F.col("doc_id") % 3 == 1, F.element_at(F.create_map(
                      *[F.lit(x) for x in ("en", "eng", "fr", "fra", "de", "deu", "es", "spa")]),
                      F.col("lang")))
                  .otherwise(F.element_at(F.create_map(
                      *[F.lit(x) for x in ("en", "English", "fr", "French", "de", "German", "es", "Spanish")]),
                      F.col("lang"))))
        branch = F.concat(F.lit("u"), (F.col("doc_id") % 5).cast("string"))
        return (n.withColumn("branch", branch)
                .withColumn("basename", F.concat(F.col("nr").cast("string"), F.lit(".xml")))
                .withColumn("name", F.concat(F.lit("part-"), F.col("nr").cast("string"), F.lit("_"),
                                             marker, F.lit(".xml")))
                .withColumn("path", F.concat_ws("/", "slot", "branch", F.lit("xml"), "lang", "basename"))
                .withColumn("gid", F.concat(F.lit("g"), (F.col("doc_id") % 3).cast("string")))
                .withColumn("owner", F.concat(F.lit("user"), (F.col("doc_id") % 5).cast("string")))
                .select("doc_id", "path", "slot", "branch", "lang", "basename", "name", "nr", "size",
                        "gid", "owner"))

    @cached_property
    def metadata(self) -> DataFrame:
        """Catalog records: known keys as columns, all others in a map."""
        r = self.resources.join(self.labels, "doc_id", "left")
        keywords = F.concat_ws(",", "slot", "lang", F.when(F.col("size") >= 10, "long").otherwise("short"))
        meta = catalog.record({
            "resource-type": F.lit("corpusfile"), "language": F.col("lang"), "size": F.col("size"),
            "gid": F.col("gid"), "owner": F.col("owner"), "keywords": keywords, "quality": F.col("quality")})
        return r.select("path", "slot", "branch", meta.alias("meta"))

    @cached_property
    def groups(self) -> DataFrame:
        """Group membership: who touched the same event type, keyed by user."""
        e = self.events.select(
            F.concat(F.lit("g"), (F.col("user_id") % 3).cast("string")).alias("gid"),
            F.concat(F.lit("user"), (F.col("user_id") % 7).cast("string")).alias("member"),
            "event_type").where(F.col("event_type") != "error")
        return e.groupBy("gid").agg(
            F.min("member").alias("owner"), F.array_sort(F.collect_set("member")).alias("members"))

    @cached_property
    def doc_pairs(self) -> DataFrame:
        """Documents of one slot with the same base name in two languages."""
        return match.identical(self.resources, key=["slot", "basename"])

    @cached_property
    def sentences(self) -> DataFrame:
        """Non-empty lines of each document, numbered from 1."""
        lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
        return self.documents.select(
            "doc_id", "lang", F.posexplode(lines).alias("pos0", "text")).select(
            "doc_id", "lang", (F.col("pos0") + 1).cast("bigint").alias("sent_pos"), "text")

    @cached_property
    def bitext(self) -> DataFrame:
        """User turns with the assistant turn that follows them."""
        c = self.conversations
        user = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("src_text"))
        answer = c.where("role = 'assistant'").select(
            "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("trg_text"))
        return user.join(answer, ["conv_id", "turn"]).select(
            F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("pair_id"),
            "conv_id", "turn", "src_text", "trg_text")
