"""Token sequences: encoding, batching and augmentation. The canonical relation is (doc_id, toks array<int>)."""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import tokens as K
from corpusloom.functions.batches import byte_buffer
from corpusloom.session import make_importable
from corpusloom.sources.tables import numbered


def encode(docs: DataFrame, bos: int | None = None, eos: int | None = None, key: str = "doc_id") -> DataFrame:
    """(key, toks): bytes of the text, by Arrow buffers: the text column's own bytes, widened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = byte_buffer(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(data.astype(np.int32)))], names=[key, "toks"])

    make_importable(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"{key} {kind}, toks array<int>")
    return rows if bos is None and eos is None else rows.select(key, K.with_bounds(F.col("toks"), bos, eos).alias("toks"))


def packed(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, toks binary): the bytes of the text as they are, for training, merges, n-grams and lattices, to which a binary column is one of
    tokens below 256. Nothing is widened, and no worker makes sequences for another one."""
    return docs.select(key, F.coalesce("text", F.lit("")).cast("binary").alias("toks"))


def encode_chunks(chunks: DataFrame, key: str, order: str, bos: int | None = None, eos: int | None = None) -> DataFrame:
    """Many texts of one key, in order, as one sequence with one start and one end."""
    whole = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce("text", F.lit("")).alias("t")))).alias("parts"))
    return encode(whole.select(key, F.array_join(F.transform("parts", lambda p: p["t"]), "").alias("text")), bos, eos, key)


def positions(seqs: DataFrame) -> DataFrame:
    """(doc_id, pos from 0, tok)."""
    return seqs.select("doc_id", F.posexplode("toks").alias("pos", "tok"))


def batches(seqs: DataFrame, size: int, order: str = "doc_id") -> DataFrame:
    """With the number of the batch of size rows, by order. No task sees all rows."""
    return numbered(seqs, [order], "_number").withColumn("batch", F.floor(F.col("_number") / size).cast("bigint")).drop("_number")


def limited(rows: DataFrame, n: int, order: str = "doc_id") -> DataFrame:
    """The first n rows by order, for looks at large data."""
    return rows.orderBy(order).limit(n)


def shuffled(ids: list, seed: int) -> list:
    """The order in which a seeded shuffle puts identifiers."""
    out = list(ids)
    random.Random(seed).shuffle(out)
    return out


def batch_shapes(batched: DataFrame) -> DataFrame:
    return batched.groupBy("batch").agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size("toks")).cast("bigint").alias("width"), F.sum(F.size("toks")).alias("n_tokens"))


def summary(seqs: DataFrame) -> DataFrame:
    """Sequences, tokens and the longest sequence."""
    return seqs.agg(F.count(F.lit(1)).alias("sequences"), F.coalesce(F.sum(F.size("toks")), F.lit(0)).cast("bigint").alias("tokens"), F.coalesce(F.max(F.size("toks")), F.lit(0)).cast("bigint").alias("max_length"))


@dataclass(frozen=True)
class Augmentation:
    """mode: none, entropy (drops tokens) or diffusion (swaps neighbours); a sequence's generator is seeded by its ordinal."""

    mode: str = "none"
    strength: float = 0.0
    seed: int = 0
    ordinal_stride = 9971

    def __post_init__(self) -> None:
        if self.mode not in ("none", "entropy", "diffusion"):
            raise ValueError(f"unknown augmentation {self.mode}")

    @property
    def enabled(self) -> bool:
        return self.mode != "none" and self.strength > 0

    def apply(self, tokens: list[int], ordinal: int) -> list[int]:
        if not self.enabled or len(tokens) < 2:
            return list(tokens)
        rng = random.Random(self.seed + self.ordinal_stride * ordinal)
        if self.mode == "entropy":
            kept = [t for t in tokens if rng.random() >= self.strength]
            return kept or [tokens[rng.randrange(len(tokens))]]
        out, last = list(tokens), len(tokens) - 1
        for _ in range(round(self.strength * len(tokens))):
            i = rng.randrange(len(out))
            j = min(last, max(0, i + (-1 if rng.random() < 0.5 else 1)))
            out[i], out[j] = out[j], out[i]
        return out


def augment(seqs: DataFrame, how: Augmentation, ordinal: Column | None = None) -> DataFrame:
    """The sequences, augmented; ordinal numbers them, doc_id by default."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            done = [how.apply(t or [], int(o or 0)) for t, o in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.list_(pa.int32()))], names=["doc_id", "toks"])

    make_importable(seqs.sparkSession)
    return seqs.select("doc_id", "toks", (F.col("doc_id") if ordinal is None else ordinal).cast("bigint").alias("o")).mapInArrow(run, "doc_id bigint, toks array<int>")


def synthetic(spark, sequences: int, length: int, vocabulary: int, seed: int) -> DataFrame:
    """Uniform tokens that depend on seed, row and place alone."""
    toks = F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(vocabulary)).cast("int"))
    return spark.range(sequences).select(F.col("id").alias("doc_id"), toks.alias("toks"))


#: Two small corpora for baselines, and their other names.
BASELINES = {"tiny": ["the quick brown fox", "jumps over the lazy dog"], "mixed": ["hello world", "merhaba dünya"]}
ALIASES = {"small": "tiny", "multilingual": "mixed"}


def baseline(spark, name: str) -> DataFrame:
    texts = BASELINES[ALIASES.get(name, name)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
