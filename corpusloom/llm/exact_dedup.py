"""Exact dedup as a stream: keyed state on disk, without expiry, retains digest, stable identifier and content locator.

Arrivals (identifier, digest, code points, normalised text) are files in the shared folder, a folder for each call. A Structured
Streaming query reads them without their texts and keeps, in RocksDB state checkpointed to the shared folder, one entry a digest: how
many arrived, and which one stays, with its locator, the call and row where its content is. The same state goes on with files that
arrive later. Partial aggregation comes before the exchange, so that a text of which a third of the rows are copies is one row from
each task.

Every batch checks its hits: for a digest that has more than one arrival, the texts that came in the batch and the one that the locator
in the state leads to are compared byte by byte, distinct ones of each task first. A digest whose texts differ clashes; its rows, and no
others, are told apart by their bytes in the result.

Defined cases: null text counts as empty, and all empty or white texts are equal; of rows that repeat a doc_id and a text one is kept; a
null doc_id sorts first; an empty table gives no rows; texts of any length are compared whole; other columns are ignored."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import few, id_and_text, partitions, saved, scratch

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true", "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
#: Rows for each partition of the state, until there are as many as the session's shuffle partitions.
STATE_ROWS = 20_000
DIGEST = 32
#: A digest with one in so many rows counts as hot: there are as many of those at most.
HOT_SHARE = 1000
ARRIVAL = "doc_id long, sha binary, points int, key long, row long, text string, call long"
BEST = "struct<less:int,doc_id:long,call:long,row:long>"


def normalised(text: str | Column = "text") -> Column:
    """Without the characters of [\\x20\\x09-\\x0D]."""
    return F.translate(text, " \t\n\x0b\x0c\r", "")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def arrive(docs: DataFrame, source: str) -> int:
    """Writes documents as arrivals of a call of its own, and names it."""
    call = time.time_ns()
    rows = id_and_text(docs).withColumn("norm", normalised())
    rows = rows.select("doc_id", F.unhex(F.sha2("norm", 256)).alias("sha"), F.char_length("text").alias("points"), F.xxhash64("text").alias("key"), F.monotonically_increasing_id().alias("row"), F.col("norm").alias("text"))
    rows.write.option("compression", "zstd").parquet(f"{source}/call={call}")
    return call


def arrivals(spark: SparkSession, source: str) -> DataFrame:
    return spark.read.schema(ARRIVAL).parquet(source)


def clashes(fresh: DataFrame, earlier: DataFrame, hits: DataFrame, digest: Column) -> DataFrame:
    """Digests of hits (digest, call, row) of which unlike texts have come: fresh arrivals, and what the locators lead to in earlier ones."""
    new = fresh.select(digest.alias("digest"), "text").join(few(hits.select("digest")), "digest")
    old = earlier.select("call", "row", "text").join(few(hits), ["call", "row"]).select("digest", "text")
    return new.unionByName(old).distinct().groupBy("digest").count().where("count > 1").select("digest")


def absorb(spark: SparkSession, source: str, state: str, out: str, digest_bytes: int = DIGEST) -> tuple[DataFrame, DataFrame]:
    """Reads what has come to source since the last call with this state: all entries so far, and the digests that clash.

    An entry: digest, size and best (-code points, doc_id, call, row), the least of which stays."""
    digest = F.substring("sha", 1, digest_bytes)
    stream = spark.readStream.schema(ARRIVAL).parquet(source)
    best = F.min(F.struct((-F.col("points")).alias("less"), "doc_id", "call", "row")).alias("best")
    entries = stream.groupBy(digest.alias("digest")).agg(F.count(F.lit(1)).alias("size"), best, F.max("call").alias("newest"))

    def write(batch: DataFrame, number: int) -> None:
        batch.select("*", F.lit(number).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{out}/entries/n={number}")
        changed = spark.read.schema(f"digest binary, size long, best {BEST}, newest long").parquet(f"{out}/entries/n={number}")
        calls = [r["newest"] for r in changed.select("newest").distinct().collect()]  # one, or a few that came since the last call
        hits = changed.where("size > 1").select("digest", "best.call", "best.row")
        everything = arrivals(spark, source)
        fresh, earlier = everything.where(F.col("call").isin(calls)), everything.where(~F.col("call").isin(calls))
        clashes(fresh, earlier, hits, digest).write.mode("overwrite").parquet(f"{out}/clashes/n={number}")

    wanted = min(partitions(spark), arrivals(spark, source).count() // STATE_ROWS + 1)  # fixed by the first call with a state
    with settings(spark, SETTINGS | {"spark.sql.shuffle.partitions": str(wanted)}):
        query = entries.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
    changes = spark.read.schema(f"digest binary, size long, best {BEST}, newest long, batch long").option("recursiveFileLookup", "true").parquet(f"{out}/entries")
    unlike = spark.read.schema("digest binary").option("recursiveFileLookup", "true").parquet(f"{out}/clashes").distinct()
    return changes.groupBy("digest").agg(F.max_by(F.struct("size", "best"), "batch").alias("last")).select("digest", "last.size", "last.best"), unlike


def resolved(rows: DataFrame, entries: DataFrame, on: str) -> DataFrame:
    """Each row with the entry of its group. Groups of one need no entry; those of a thousandth of all rows are sent to all tasks."""
    total = entries.agg(F.sum("size")).first()[0] or 0
    several = entries.where("size > 1")
    hot = several.where(F.col("size") > max(1000, total // HOT_SHARE))
    often = rows.join(F.broadcast(hot), on)
    seldom = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(several, on, "left")
    alone = F.struct((-F.col("points")).alias("less"), "doc_id", "call", "row")
    return often.unionByName(seldom).withColumn("best", F.coalesce("best", alone)).withColumn("size", F.coalesce("size", F.lit(1).cast("long")))


def exact_duplicates(docs: DataFrame, digest_bytes: int = DIGEST) -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256, key (xxhash64 of the text) and the locator of the row
    that stays. digest_bytes: how much of the SHA-256 is the state's digest."""
    spark = docs.sparkSession
    base = scratch(spark, "exact")
    source = f"{base}/arrivals"
    arrive(docs, source)
    digest = F.substring("sha", 1, digest_bytes)
    rows = arrivals(spark, source).select("doc_id", digest.alias("digest"), "sha", "points", "key", "call", "row")
    if rows.isEmpty():
        entries = spark.createDataFrame([], f"digest binary, size long, best {BEST}")
        unlike = entries.select("digest")
    else:
        entries, unlike = absorb(spark, source, f"{base}/state", f"{base}/entries", digest_bytes)
        entries = saved(entries, "entries")
    if unlike.isEmpty():
        joined = resolved(rows, entries, "digest")
    else:
        by_bytes = arrivals(spark, source).select("doc_id", digest.alias("digest"), "sha", "points", "key", "call", "row", "text").join(few(unlike), "digest")
        best = F.min(F.struct((-F.col("points")).alias("less"), "doc_id", "call", "row")).alias("best")
        groups = saved(by_bytes.groupBy("text").agg(F.count(F.lit(1)).alias("size"), best), "groups")
        told = resolved(by_bytes.drop("digest"), groups, "text").drop("text")
        joined = resolved(rows.join(few(unlike), "digest", "left_anti"), entries.join(few(unlike), "digest", "left_anti"), "digest").drop("digest").unionByName(told)
    here = F.struct("call", "row")
    return joined.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("size").alias("group_size"), (here == F.struct("best.call", "best.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "key", F.struct("best.call", "best.row").alias("locator"),
    )
