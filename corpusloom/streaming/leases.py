"""Leases of chunks as a stateful stream: grant, complete, heartbeat and fail events by chunk; silent leases are requeued."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.session import make_importable
from corpusloom.sources.tables import shared_dir

OUT = "chunk_id bigint, rank string, status string, attempts bigint"
STATE = "rank string, status string, attempts bigint, seen bigint"


def step(status: str, attempts: int, event: str) -> tuple[str, int]:
    """The state machine: free, leased, done."""
    if status == "done":
        return status, attempts
    if event == "grant":
        return "leased", attempts + 1
    if event == "complete":
        return "done", attempts
    if event in ("fail", "timeout"):
        return "free", attempts
    return status, attempts


def leases(events: DataFrame, timeout_ms: int | None = 60_000) -> DataFrame:
    """events (chunk_id, at bigint, rank, event), a stream: the state of each chunk after each batch.

    Without timeout_ms silent leases stay; a query that ends by itself needs that, since timeouts ask for ever more batches."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rank, status, attempts, seen = state.get if state.exists else ("", "free", 0, -1)
        if state.hasTimedOut:
            status, attempts = step(status, attempts, "timeout")
        else:
            rows = pd.concat(list(batches)).sort_values("at", kind="stable")
            for r in rows.itertuples():
                status, attempts = step(status, attempts, r.event)
                rank, seen = r.rank, int(r.at)
        state.update((rank, status, attempts, seen))
        if status == "leased" and timeout_ms is not None:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({"chunk_id": [key[0]], "rank": [rank], "status": [status], "attempts": [attempts]})

    make_importable(events.sparkSession)
    return events.groupBy("chunk_id").applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def final_states(spark: SparkSession, events: DataFrame) -> DataFrame:
    """The last state of each chunk, after all of a table of events have gone through leases() as a stream.

    Events are written in order of their time, and the stream takes them in one batch, so that a chunk's events come in order."""
    base = f"{shared_dir(spark)}/corpusloom/leases-{uuid.uuid4().hex}"
    events.write.parquet(f"{base}/events")
    source = spark.readStream.schema(events.schema).parquet(f"{base}/events")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/states/n={number}")

    query = leases(source, None).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    states = spark.read.schema(f"{OUT}, batch int").option("recursiveFileLookup", "true").parquet(f"{base}/states")
    return states.groupBy("chunk_id").agg(F.max_by(F.struct("rank", "status", "attempts"), "batch").alias("last")).select("chunk_id", "last.rank", "last.status", "last.attempts")


def chunks(total: int, width: int) -> list[tuple[int, int, int]]:
    """(chunk_id, start, end), half open."""
    return [(i, a, min(total, a + width)) for i, a in enumerate(range(0, total, width))]


def chunk_rows(totals: DataFrame, width: int) -> DataFrame:
    """chunks() of many totals (key, total) at once: (key, chunk_id, start, end)."""
    numbers = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("total") / width) - 1, F.lit(0)).cast("bigint"))
    cut = totals.where("total > 0").select("key", "total", F.explode(numbers).alias("chunk_id"))
    return cut.select("key", "chunk_id", (F.col("chunk_id") * width).alias("start"), F.least(F.col("chunk_id") * width + width, F.col("total")).alias("end"))


def job_id(paths: list[str]) -> str:
    """A name for the work over some paths, in their order."""
    ended = b"".join(p.encode("utf-8", "surrogatepass") + b"\0" for p in paths)
    return f"lease:{hashlib.blake2s(ended, digest_size=8).hexdigest()}"
