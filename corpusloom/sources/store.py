"""Small whole files in any store that Spark reads: a path with a scheme goes through the cluster's file systems, another one is local."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def _there(path: str):
    """The file system of a path, and the path, as the JVM has them."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError(f"{path} needs a session")
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark._jsc.hadoopConfiguration()), name


def remote(path: str) -> bool:
    return "://" in path or path.startswith("file:")


def write_text(path: str, text: str) -> None:
    """The whole file or none of it: it is written under another name first."""
    if not remote(path):
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        part = f"{path}.part"
        with open(part, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(part, path)
        return
    fs, part = _there(f"{path}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    name = _there(path)[1]
    fs.delete(name, False)
    if not fs.rename(part, name):
        raise OSError(f"{path} can't be written")


def read_text(path: str) -> str:
    if not remote(path):
        with open(path, encoding="utf-8") as f:
            return f.read()
    rows = SparkSession.getActiveSession().read.format("binaryFile").load(path).select("content").collect()
    return bytes(rows[0]["content"]).decode()


def exists(path: str) -> bool:
    if not remote(path):
        return os.path.exists(path)
    fs, name = _there(path)
    return bool(fs.exists(name))
