"""Streams of shards and of documents: offsets and exactly-once come of the query's checkpoint, rates of the source's options."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import histograms, sequences
from corpusloom.sources import files
from corpusloom.sources.tables import saved


def shard_stream(spark: SparkSession, folder: str, files_per_batch: int = 8) -> DataFrame:
    """Shards as they come, contents decompressed: (path, codec, content)."""
    raw = spark.readStream.format("binaryFile").schema(files.SHARDS).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return files.decompressed(raw)


def document_stream(spark: SparkSession, folder: str, schema: str = "doc_id bigint, text string", files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


class PairCounts:
    """Pair counts of all documents so far, kept up by new documents alone. Each micro-batch writes its own counts under its number, so
    that a batch that is run again replaces itself; compact() adds them up."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def absorb(self, stream: DataFrame, checkpoint: str) -> None:
        def batch(df: DataFrame, number: int) -> None:
            histograms.pairs(sequences.encode(df)).write.mode("overwrite").parquet(f"{self.folder}/n={number}")

        stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def counts(self) -> DataFrame:
        parts = self.spark.read.schema("key bigint, cnt bigint").option("recursiveFileLookup", "true").parquet(self.folder)
        return parts.groupBy("key").agg(F.sum("cnt").alias("cnt"))


def stream_pair_counts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The counts that a stream over a table's documents ends with."""
    from corpusloom.sources.tables import shared_dir
    from uuid import uuid4

    base = f"{shared_dir(spark)}/corpusloom/stream-{uuid4().hex}"
    docs.select(F.col("doc_id").cast("bigint"), "text").write.parquet(f"{base}/in")
    if docs.isEmpty():
        return spark.createDataFrame([], "key bigint, cnt bigint")
    counts = PairCounts(spark, f"{base}/counts")
    counts.absorb(document_stream(spark, f"{base}/in"), f"{base}/state")
    return saved(counts.counts(), "counts")
