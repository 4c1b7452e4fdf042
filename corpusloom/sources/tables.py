"""Tables of intermediate results in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset: on a local master a folder of our own, else one in the warehouse, which all
    executors share."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            path = f"file://{tempfile.mkdtemp(prefix='corpusloom-')}"
        else:
            path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/corpusloom-checkpoints"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column | str], number: str = "number") -> DataFrame:
    """df with each row's place, from 0 on, in an order; ties are put in any order, once and for all.

    Rows are sorted by ranges and written; a row's place is its place in its range and the number of rows in the ranges before. Both are
    read from what was written, since a range has no fixed partition while adaptive execution may still join partitions."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = saved(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "numbered")
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each partition
    return placed.join(F.broadcast(before), "_part").withColumn(number, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


#: Bytes for each core below which a table of few files is dealt out anew.
SMALL = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than there are cores, and too small for its splits to keep them all busy, dealt out to them; any other as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL else df
