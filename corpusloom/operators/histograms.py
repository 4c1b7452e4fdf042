"""Counts of tokens, adjacent pairs and n-grams, and the algebra of histograms.

A task counts its own tokens in numpy and sends one row for each distinct key, so that what is shuffled is bounded by the number of keys,
however skewed they are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import tokens as K
from corpusloom.functions.batches import byte_buffer, slices
from corpusloom.session import make_importable


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, or of a binary one, whose tokens are bytes, and the bounds of its rows; a null row is empty."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return byte_buffer(column)
    values = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.array(column.value_lengths().fill_null(0))
    return values, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def pair_keys(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Keys of adjacent pairs that lie inside one row, both tokens valid."""
    if len(values) < 2:
        return np.empty(0, np.int64)
    v = values.astype(np.int64)
    inside = np.ones(len(v) - 1, bool)
    inside[(bounds[1:-1] - 1)[(bounds[1:-1] > 0) & (bounds[1:-1] < len(v))]] = False
    inside &= (v[:-1] >= 0) & (v[1:] >= 0)
    return (v[:-1] << 32 | v[1:])[inside]


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and counts; small ids by a table, others by sorting."""
    if len(keys) and keys.max() >> 32 < 256 and (keys & 0xFFFFFFFF).max() < 256:
        table = np.bincount((keys >> 32 << 8) | (keys & 255), minlength=65536)
        at = np.flatnonzero(table)
        return (at >> 8) << 32 | at & 255, table[at]
    return np.unique(keys, return_counts=True)


def pairs(seqs: DataFrame) -> DataFrame:
    """The adjacent pairs of sequences: (key, cnt)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = (np.empty(0, np.int64), np.empty(0, np.int64))
        for b in batches:
            k, c = counted(pair_keys(*flat(b.column(0))))
            total = summed(np.concatenate([total[0], k]), np.concatenate([total[1], c]))
        yield pa.RecordBatch.from_arrays([pa.array(total[0], pa.int64()), pa.array(total[1], pa.int64())], names=["key", "cnt"])

    make_importable(seqs.sparkSession)
    return total_of(seqs.select("toks").mapInArrow(run, "key bigint, cnt bigint"))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k, inverse = np.unique(keys, return_inverse=True)
    return k, np.bincount(inverse, weights=counts, minlength=len(k)).astype(np.int64)


def pairs_sql(seqs: DataFrame) -> DataFrame:
    """The same by built-in functions alone."""
    return seqs.select(F.explode(K.adjacent_pairs(F.col("toks"))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("cnt"))


def tokens(seqs: DataFrame) -> DataFrame:
    """(tok, cnt)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = (np.empty(0, np.int64), np.empty(0, np.int64))
        for b in batches:
            v = flat(b.column(0))[0].astype(np.int64)
            k, c = np.unique(v[v >= 0], return_counts=True)
            total = summed(np.concatenate([total[0], k]), np.concatenate([total[1], c]))
        yield pa.RecordBatch.from_arrays([pa.array(total[0].astype(np.int32)), pa.array(total[1], pa.int64())], names=["tok", "cnt"])

    make_importable(seqs.sparkSession)
    return seqs.select("toks").mapInArrow(run, "tok int, cnt bigint").groupBy("tok").agg(F.sum("cnt").alias("cnt"))


def total_of(*histograms: DataFrame) -> DataFrame:
    """The sum of histograms (key, cnt)."""
    out = histograms[0]
    for h in histograms[1:]:
        out = out.unionByName(h)
    return out.groupBy("key").agg(F.sum("cnt").alias("cnt"))


def minus(left: DataFrame, right: DataFrame) -> DataFrame:
    """left - right; keys whose count becomes 0 go."""
    return total_of(left, right.select("key", (-F.col("cnt")).alias("cnt"))).where("cnt != 0")


#: Distinct packed n-grams that a task holds before it sends them.
GRAMS_HELD = 500_000


def ngrams(seqs: DataFrame, least: int, most: int) -> DataFrame:
    """(n, gram array<int>, cnt) of all orders from least to most.

    A task packs each window into its bytes, counts, and sends distinct windows only."""

    def rows(n: int, grams: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, grams.size + 1, n, dtype=np.int32)), pa.array(np.ascontiguousarray(grams).ravel(), pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(c), n, np.int32)), lists, pa.array(c, pa.int64())], names=["n", "gram", "cnt"])

    def unpacked(n: int, k: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(k), 100_000):
            part = k[i : i + 100_000]
            yield rows(n, np.stack([part >> 8 * (n - 1 - j) & 255 for j in range(n)], axis=1).astype(np.int32), c[i : i + 100_000])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {n: [] for n in range(least, most + 1)}
        for b in slices(batches, 0):
            values, bounds = flat(b.column(0))
            values = np.ascontiguousarray(values, np.int32)
            doc_end = np.repeat(bounds[1:], np.diff(bounds))
            for n in range(least, most + 1):
                at = np.flatnonzero(np.arange(len(values)) + n <= doc_end)
                if not len(at):
                    continue
                if values.min() >= 0 and values.max() < 256 and n <= 7:
                    packed = np.zeros(len(at), np.int64)
                    for i in range(n):
                        packed = packed << 8 | values[at + i]
                    held[n].append(np.unique(packed, return_counts=True))
                    if sum(len(k) for k, _ in held[n][1:]) > GRAMS_HELD:
                        held[n] = [summed(*map(np.concatenate, zip(*held[n], strict=True)))]
                        if len(held[n][0][0]) > GRAMS_HELD:
                            yield from unpacked(n, *held[n].pop())
                else:
                    grid = np.lib.stride_tricks.sliding_window_view(values, n)[at]
                    grams, c = np.unique(grid, axis=0, return_counts=True)
                    keep = (grams >= 0).all(axis=1)
                    if keep.any():
                        yield rows(n, grams[keep], c[keep])
        for n, found in held.items():
            if found:
                yield from unpacked(n, *summed(*map(np.concatenate, zip(*found, strict=True))))

    make_importable(seqs.sparkSession)
    return seqs.select("toks").mapInArrow(run, "n int, gram array<int>, cnt bigint").groupBy("n", "gram").agg(F.sum("cnt").alias("cnt"))


def packed_key(gram, n: int):
    """The packed key of a gram where packing is injective: as many bits a token as 64 bits allow, 16 at least."""
    bits = max(16, 64 // n)
    if bits * n > 64:
        raise ValueError(f"{n} tokens do not fit 64 bits")
    return F.aggregate(gram, F.lit(0).cast("bigint"), lambda acc, t: F.shiftleft(acc, bits).bitwiseOR(t.cast("bigint")))


def top(histogram: DataFrame, k: int, excluded: DataFrame | None = None) -> DataFrame:
    """The k most frequent keys, lower keys first among equals; excluded keys don't count."""
    rows = histogram if excluded is None else histogram.join(excluded.select("key"), "key", "left_anti")
    return rows.orderBy(F.desc("cnt"), "key").limit(k)


def tied(histogram: DataFrame) -> DataFrame:
    """All keys of the highest count, in order."""
    best = histogram.agg(F.max("cnt").alias("cnt"))
    return histogram.join(F.broadcast(best), "cnt").select("key", "cnt").orderBy("key")


def runs(positions: DataFrame) -> DataFrame:
    """Runs of equal tokens (doc_id, start, length, tok)."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    new = F.coalesce((F.lag("tok").over(w) != F.col("tok")), F.lit(True)).cast("int")
    numbered = positions.withColumn("run", F.sum(new).over(w))
    return numbered.groupBy("doc_id", "run", "tok").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("length")).select("doc_id", "start", "length", "tok")


def compacted(positions: DataFrame, drop) -> DataFrame:
    """Positions that stay when some are dropped, with their new places."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return positions.withColumn("stays", (~drop).cast("int")).withColumn("new_pos", F.sum("stays").over(w) - 1).where("stays = 1").drop("stays")


def neighbours(positions: DataFrame, merged) -> DataFrame:
    """With touched: at a merged position or beside one."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    m = merged.cast("int")
    return positions.withColumn("touched", (F.greatest(m, F.coalesce(F.lag(m).over(w), F.lit(0)), F.coalesce(F.lead(m).over(w), F.lit(0))) == 1))
