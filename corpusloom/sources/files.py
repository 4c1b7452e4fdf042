"""Text, code and compressed shards as DataFrames. Paths may be of any store that Spark reads."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusloom.session import make_importable
from corpusloom.sources.store import exists
from corpusloom.sources.tables import numbered

SHARDS = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
#: What ends a line, beyond carriage return and line feed.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
#: Languages by file suffix.
SUFFIXES = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript"}


def shards(spark: SparkSession, paths: list[str], recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length, content); an error where no file is found."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(paths)
    if not df.inputFiles():
        raise FileNotFoundError(f"no files in {paths}")
    return df


def listing(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Paths and lengths, sorted; file contents are not read."""
    return shards(spark, paths).select("path", "length").orderBy("path")


def of_rank(paths: DataFrame, rank: int, world: int) -> DataFrame:
    """Every world-th of the distinct sorted paths, from rank on."""
    numbered = paths.select("path").distinct().withColumn("i", F.row_number().over(Window.orderBy("path")) - 1)  # a list of files
    return numbered.where(F.pmod("i", F.lit(world)) == rank).select("path")


def slice_of(content: Column, start: Column | int, length: Column | int) -> Column:
    """Bytes from start (from 0) of a shard."""
    return F.substring(content, (F.lit(start) if isinstance(start, int) else start) + 1, F.lit(length) if isinstance(length, int) else length)


def codec_of(path: Column) -> Column:
    return F.when(path.endswith(".zst") | path.endswith(".zstd"), "zstd").when(path.endswith(".lz4"), "lz4").when(path.endswith(".gz"), "gzip").otherwise("none")


def decompressed(shard: DataFrame) -> DataFrame:
    """Shards with their contents as they were before compression, by suffix: zstd, gzip, lz4 where its package is installed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, codec, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([codec]), pa.array([expand(codec, data)], pa.binary())], names=["path", "codec", "content"])

    make_importable(shard.sparkSession)
    return shard.select("path", codec_of(F.col("path")).alias("codec"), "content").mapInArrow(run, "path string, codec string, content binary")


def expand(codec: str, data: bytes) -> bytes:
    if codec == "zstd":
        import io

        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)).read()
    if codec == "gzip":
        import gzip

        return gzip.decompress(data)
    if codec == "lz4":
        try:
            import lz4.frame
        except ImportError as e:
            raise RuntimeError("lz4 shards need the lz4 package") from e
        return lz4.frame.decompress(data)
    return data


def whole_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, text), a row for each file."""
    return shards(spark, paths).select("path", F.decode("content", "UTF-8").alias("text"))


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(doc_id, path, text) of all lines that are not empty; doc_id follows path and line.

    Files are read by splits, which end at line feeds and carriage returns; what else ends a line is looked for in each."""
    if not spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).inputFiles():
        raise FileNotFoundError(f"no files in {paths}")
    rows = spark.read.option("recursiveFileLookup", "true").text(paths)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"), "value")
    cut = rows.select("path", "_start", "_row", F.posexplode(F.split("value", LINE_ENDS)).alias("_line", "text")).where("text != ''")
    return numbered(cut, ["path", "_start", "_row", "_line"], "doc_id").select("doc_id", "path", "text")


def lines_of(shard: DataFrame) -> DataFrame:
    """lines() of shards (path, content), whose contents are at hand as a whole, as decompressed() gives them."""
    cut = shard.select("path", F.posexplode(F.split(F.decode("content", "UTF-8"), LINE_ENDS)).alias("_line", "text")).where("text != ''")
    return numbered(cut, ["path", "_line"], "doc_id").select("doc_id", "path", "text")


def code(spark: SparkSession, paths: list[str], languages: set[str] | None = None) -> DataFrame:
    """(path, pos, language, source, filename) of manifests (.json, .jsonl, .ndjson: a list, or entries) and of source files by suffix."""
    entry = "struct<language:string,source:string,filename:string>"
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    files = whole_texts(spark, paths).withColumn("suffix", suffix)
    rows = F.filter(F.split("text", LINE_ENDS), lambda x: F.trim(x) != "")
    listed = F.when(F.col("suffix").isin("jsonl", "ndjson"), F.transform(rows, lambda x: F.from_json(x, entry[7:-1].replace(":", " "))))
    array = F.coalesce(F.from_json("text", f"array<{entry}>"), F.from_json("text", f"entries array<{entry}>")["entries"])
    listed = listed.when(F.col("suffix") == "json", array)
    by_suffix = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    raw = F.array(F.struct(by_suffix[F.col("suffix")].alias("language"), F.col("text").alias("source"), F.col("path").alias("filename")))
    out = files.select("path", F.posexplode(F.coalesce(listed, raw)).alias("pos", "e")).select("path", "pos", F.lower("e.language").alias("language"), F.col("e.source").alias("source"), F.col("e.filename").alias("filename"))
    return out.where(F.col("language").isin([x.lower() for x in languages])) if languages else out


def not_consumed(shard: DataFrame, consumed: DataFrame) -> DataFrame:
    """Shards (path) without those of consumed (path, offset)."""
    return shard.join(consumed.select("path").distinct(), "path", "left_anti")


def remember(shard: DataFrame, folder: str) -> None:
    """Adds shards (path, length) to a folder's record of what has been consumed, each with the offset behind its last byte."""
    shard.select("path", F.col("length").cast("bigint").alias("offset")).write.mode("append").parquet(folder)


def remembered(spark: SparkSession, folder: str) -> DataFrame:
    """(path, offset), the furthest of each path, of a folder's record; empty where there is none yet."""
    kind = "path string, offset bigint"
    if not exists(folder):
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).parquet(folder).groupBy("path").agg(F.max("offset").alias("offset"))
