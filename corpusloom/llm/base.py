"""What the operators share: reading the tables, and tables written to the folder that the whole cluster shares."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import make_importable
from corpusloom.sources.tables import saved, shared_dir, spread  # noqa: F401  (the operators take saved() from here)

#: Text handled at once inside a Python worker, in bytes.
SLICE_CHARS = 4_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Rows of an Arrow batch: a setting, its default, and what the operators take instead, since texts may be long.
BATCH_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000")


def ready(spark: SparkSession) -> SparkSession:
    """The session, for operators that send texts to Python workers. Batches are made smaller unless the session sets their size."""
    key, usual, ours = BATCH_ROWS
    if spark.conf.get(key) == usual:
        spark.conf.set(key, ours)
    return make_importable(spark)


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the two columns that the operators read, so that no other column can clash."""
    ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def few(df: DataFrame, most: int = 250_000) -> DataFrame:
    """df, a few narrow columns, for a join: sent to all tasks if it has no more than so many rows, which are counted."""
    return F.broadcast(df) if df.count() <= most else df


def slices_of(batch: pa.RecordBatch, texts: int = 1, size: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose texts or bytes, in a column by number, have at most size bytes together, or that are a single longer one."""
    if batch.nbytes <= size:
        if batch.num_rows:
            yield batch
        return
    start = held = 0
    for i, n in enumerate(pc.coalesce(pc.binary_length(batch.column(texts)), 0).to_pylist()):
        if i > start and held + n > size:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def text_slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_CHARS, more: bool = False) -> Iterator[tuple]:
    """Ids and texts of (doc_id, text, ...) batches, by slices_of(); more: the third column as well."""
    for batch in batches:
        for b in slices_of(batch, 1, size):
            keys, texts, *rest = (b.column(i).to_pylist() for i in range(3 if more else 2))
            yield keys, [x or "" for x in texts], *rest
