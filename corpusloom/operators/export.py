"""Vocabularies and embedding tables for export: pruning by frequency, deduplication by cosine similarity, matrices."""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Iterator
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.session import make_importable
from corpusloom.sources.tables import saved


def with_stats(vocab: DataFrame, stats: DataFrame) -> DataFrame:
    """(token, id) with count (0 where unknown) and vector."""
    return vocab.join(stats.select("token", F.col("count"), "vector"), "token", "left").select("token", "id", F.coalesce("count", F.lit(0.0)).alias("count"), "vector")


def pruned(vocab: DataFrame, least: float, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Tokens of at least that count or kept by name, renumbered, and the log of the others."""
    stays = (F.col("count") >= least) | F.col("token").isin(keep or [""])
    kept = vocab.where(stays).withColumn("new_id", F.row_number().over(Window.orderBy("id", "token")) - 1)  # a vocabulary, not a corpus
    log = vocab.where(~stays).select("token", "id", "count", F.lit(None).cast("string").alias("merged_into"), F.lit(None).cast("double").alias("similarity"), F.lit("pruned").alias("action"))
    return kept, log


def relative(counts: DataFrame, threshold: float) -> DataFrame:
    """(tok, cnt) of at least that share of all, renumbered; the most frequent one if none has."""
    total = counts.agg(F.sum("cnt").alias("total"), F.min_by("tok", F.struct(-F.col("cnt"), "tok")).alias("top"), F.max("cnt").alias("most"))
    marked = counts.crossJoin(F.broadcast(total)).where((F.col("cnt") / F.col("total") >= threshold) | ((F.col("most") / F.col("total") < threshold) & (F.col("tok") == F.col("top"))))
    return marked.select("tok", "cnt", (F.row_number().over(Window.orderBy("tok")) - 1).alias("new_id"))  # a vocabulary, not a corpus


def reindexed(samples: DataFrame, kept: DataFrame) -> DataFrame:
    """Samples (token, …) of the tokens that are kept (token, new_id), with their new ids; others go."""
    return samples.join(kept.select("token", "new_id"), "token")


def standing_vector(token: str, size: int, seed: int = 0) -> list[float]:
    """What stands for a token without a vector when tokens are compared: numbers between -1 and 1 that depend on token and seed."""
    rng = random.Random(int.from_bytes(hashlib.sha256(f"{seed}:{token}".encode()).digest()[:8], "big"))
    return [rng.uniform(-1.0, 1.0) for _ in range(max(1, size))]


def similarity(x: list[float], y: list[float]) -> float:
    pairs = list(zip(x, y, strict=False))
    a, b = math.sqrt(sum(p * p for p, _ in pairs)), math.sqrt(sum(q * q for _, q in pairs))
    return sum(p * q for p, q in pairs) / (a * b) if a and b else -1.0


def mixed(x: list[float], w: float, y: list[float], v: float) -> list[float]:
    """The mean of two vectors by weights, the shorter one filled with zeros."""
    return [(w * p + v * q) / (w + v) for p, q in zip_longest(x, y, fillvalue=0.0)]


class Clusters:
    """Tokens in order: each joins the most similar cluster (the later one among equals) from the threshold on, or makes its own.

    A cluster is compared by the mean of what its tokens are compared by, made-up vectors included; its own vector is the mean of the
    given ones alone, null where none was given. Weights are counts, 1 for a count of 0. Tokens to keep are never joined to others."""

    def __init__(self, threshold: float, keep: set[str]) -> None:
        self.threshold, self.keep = threshold, keep
        self.heads: list[dict] = []
        self.log: list[dict] = []

    def add(self, token: str, ident: int, count: float, vector: list[float] | None, compared: list[float]) -> None:
        best, into = self.threshold, None
        for h in self.heads if token not in self.keep else []:
            if (s := similarity(compared, h["compared"])) >= best:
                best, into = s, h
        weight = count if count > 0 else 1.0
        if into is None:
            self.heads.append({"token": token, "id": ident, "count": count, "vector": vector, "weight": weight if vector else 0.0, "compared": compared})
            return
        into["compared"] = mixed(into["compared"], into["count"] if into["count"] > 0 else 1.0, compared, weight)
        into["count"] += count
        if vector:
            into["vector"] = mixed(into["vector"], into["weight"], vector, weight) if into["vector"] else vector
            into["weight"] += weight
        self.log.append({"token": token, "id": ident, "count": count, "merged_into": into["token"], "similarity": best, "action": "deduped"})


def deduplicated(vocab: DataFrame, threshold: float, keep: list[str] | None = None, size: int = 16, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Vocabulary (token, id, count, vector) by clusters, and the log of merges; a threshold of 0 or less merges nothing. The order of tokens decides, so that one task does it
    over the vocabulary, in order of ids; pairs() is the parallel form."""
    head = "token string, id bigint, count double, vector array<double>"
    log = "token string, id bigint, count double, merged_into string, similarity double, action string"

    def run(which: str):
        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = Clusters(threshold if threshold > 0 else math.inf, set(keep or ()))
            for b in batches:
                for t, i, n, v in zip(*(x.to_pylist() for x in b.columns), strict=True):
                    c.add(t, i, n or 0.0, v or None, v or standing_vector(t, size, seed))
            rows = c.heads if which == "heads" else c.log
            numbers = pa.list_(pa.float64())
            kinds = [("token", pa.string()), ("id", pa.int64()), ("count", pa.float64())] + ([("vector", numbers)] if which == "heads" else [("merged_into", pa.string()), ("similarity", pa.float64()), ("action", pa.string())])
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))

        return f

    make_importable(vocab.sparkSession)
    one = vocab.select("token", F.col("id").cast("bigint"), F.col("count").cast("double"), F.col("vector").cast("array<double>")).coalesce(1).sortWithinPartitions("id", "token")
    return one.mapInArrow(run("heads"), head), one.mapInArrow(run("log"), log)


def similar(xi: np.ndarray, x: np.ndarray, yi: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids a < b and similarities of two blocks' rows; same: the two are one block. A product of single precision, with more than its
    error as a margin, finds the candidates, which are computed again in double precision."""
    d = min(x.shape[1], y.shape[1])
    x, y = x[:, :d].astype(np.float64), y[:, :d].astype(np.float64)
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    unit = lambda v, n: (v / np.sqrt(np.where(n == 0, 1.0, n))[:, None]).astype(np.float32)
    ux, uy = unit(x, xx), unit(y, yy).T
    least = threshold - (d + 8) * 2.5e-7
    for at in range(0, len(x), 512):
        rows, cols = np.nonzero(~(ux[at : at + 512] @ uy < least))
        rows += at
        keep = xi[rows] != yi[cols]
        if same:
            keep &= rows < cols
        rows, cols = rows[keep], cols[keep]
        for k in range(0, len(rows), 50_000):
            i, j = rows[k : k + 50_000], cols[k : k + 50_000]
            norm = np.sqrt(xx[i] * yy[j])
            cos = np.where(norm == 0, -1.0, np.einsum("ij,ij->i", x[i], y[j]) / np.where(norm == 0, 1.0, norm))
            hit = ~(cos < threshold)
            a, b = xi[i[hit]], yi[j[hit]]
            yield np.minimum(a, b), np.maximum(a, b), cos[hit]


def links(vectors: DataFrame, threshold: float, ident: str = "vec_id", vector: str = "embedding", block: int = 2048) -> DataFrame:
    """(vec_id, links, best) of rows with others at least so similar: how many, and the highest similarity. No pair leaves its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in met(batches, threshold):
            ids, at = np.unique(np.concatenate([found[0], found[1]]), return_inverse=True)
            best = np.full(len(ids), -np.inf)
            np.maximum.at(best, at, np.concatenate([found[2], found[2]]))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.bincount(at)), pa.array(best)], names=["id", "n", "best"])

    found = met_blocks(vectors, ident, vector, block).mapInArrow(run, "id bigint, n bigint, best double")
    return found.groupBy(F.col("id").alias(ident)).agg(F.sum("n").alias("links"), F.max("best").alias("best"))


def all_pairs(vectors: DataFrame, threshold: float, ident: str = "vec_id", vector: str = "embedding", block: int = 2048) -> DataFrame:
    """(a, b, similarity) of all rows at least so similar, a < b, whatever their groups. For tables whose similar rows are few: a group of
    n near vectors has n * (n - 1) / 2 rows here, and n in links()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in met(batches, threshold):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["a", "b", "similarity"])

    return met_blocks(vectors, ident, vector, block).mapInArrow(run, "a bigint, b bigint, similarity double")


def met(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What similar() finds in pairs of blocks, as met_blocks() has them."""
    for b in batches:
        for k in range(b.num_rows):
            n, d, ids, m, n2, d2, ids2, m2, kind = (c[k].as_py() for c in b.columns)
            x, y = np.frombuffer(m, kind).reshape(-1, d), np.frombuffer(m2, kind).reshape(-1, d2)
            yield from similar(np.frombuffer(ids, "<i8"), x, np.frombuffer(ids2, "<i8"), y, threshold, n == n2)


def met_blocks(vectors: DataFrame, ident: str, vector: str, block: int) -> DataFrame:
    """All pairs of blocks of vectors.

    Vectors are written as blocks of one length, a row for each, and every block meets every other: the comparisons grow with the
    square of the rows, the rows of the join with that of the blocks. Null ids, null vectors and vectors with null elements have no
    pairs; of two lengths the shorter counts, as in cosine()."""
    spark = make_importable(vectors.sparkSession)
    kind = "<f4" if vectors.schema[vector].dataType.elementType.typeName() == "float" else "<f8"
    rows = vectors.select(F.col(ident).cast("bigint").alias("i"), F.col(vector).cast("array<float>" if kind == "<f4" else "array<double>").alias("v"))
    rows = rows.where(F.col("i").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda e: e.isNull()))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[int, np.ndarray]]] = {}
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 33

        def out(d: int) -> pa.RecordBatch:
            nonlocal number
            held = waiting.pop(d)
            number += 1
            columns = [pa.array([number], pa.int64()), pa.array([d], pa.int32()), pa.array([np.array([i for i, _ in held], "<i8").tobytes()], pa.binary()), pa.array([np.stack([v for _, v in held]).astype(kind).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["block", "d", "ids", "m"])

        for b in batches:
            ends, values = b.column(1).offsets.to_numpy(), b.column(1).values.to_numpy(zero_copy_only=False)
            for i, start, end in zip(b.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                held = waiting.setdefault(end - start, [])
                held.append((i, values[start:end].copy()))
                if len(held) >= block:
                    yield out(end - start)
        for d in list(waiting):
            yield out(d)

    blocks = saved(rows.repartition(max(1, -(-rows.count() // block))).mapInArrow(packed, "block bigint, d int, ids binary, m binary"), "vectors")
    other = blocks.select(*(F.col(c).alias(f"{c}2") for c in blocks.columns))
    return blocks.join(other, F.col("block") <= F.col("block2")).withColumn("kind", F.lit(kind))


def embeddings(vocab: list[tuple[str, int, float, list[float] | None]], size: int, seed: int) -> list[list[float]]:
    """A row for each token by id: its vector where it has the size, else normal numbers of deviation size**-0.5 / sqrt(count + 1)."""
    rng, out = random.Random(seed), []
    for _, _, count, vector in sorted(vocab, key=lambda v: v[1]):
        scale = size**-0.5 / math.sqrt(count + 1)
        out.append(list(vector) if vector and len(vector) == size else [rng.gauss(0.0, scale) for _ in range(size)])
    return out


def embeddings_frame(vocab: DataFrame, size: int, seed: int) -> DataFrame:
    """The same for vocabularies of any size: each token's numbers depend on its name and the seed."""
    places = F.sequence(F.lit(1), F.lit(size))
    uniform = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.col("token"), k), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
    normal = F.transform(places, lambda i: F.sqrt(-2 * F.log(uniform(i))) * F.cos(2 * math.pi * uniform(-i)) * (size**-0.5) / F.sqrt(F.col("count") + 1))
    return vocab.select("token", "id", F.when(F.size("vector") == size, F.col("vector")).otherwise(normal).alias("vector"))
