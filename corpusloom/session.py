"""Sessions: settings that suit the operators, and the package's path for Python workers."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; on a cluster the submitted configuration stands instead."""
    builder = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", shuffle_partitions).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return make_importable(builder.getOrCreate())


#: What Python workers' allocators get told where the environment says nothing: arrays of some megabytes go back to the system when they
#: are freed, so that a worker that is used for task after task doesn't keep the most that any of them took.
ALLOCATORS = {"MALLOC_MMAP_THRESHOLD_": "4194304", "MALLOC_TRIM_THRESHOLD_": "16777216", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


#: Bytes of an Arrow batch for Python workers: a setting, its default, and what is taken instead, since a batch of 10,000 rows of texts is
#: tens of megabytes, and what Python makes of it a multiple of that.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4194304b")


def make_importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it, as --py-files does for a submitted job, and keeps what they
    get at once small unless the session sets that itself."""
    key, usual, ours = BATCH_BYTES
    if spark.conf.get(key, None) == usual:
        spark.conf.set(key, ours)
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    for key, value in ALLOCATORS.items():
        environment.setdefault(key, value)
    return spark
