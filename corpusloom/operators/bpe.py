"""Byte-pair merges: training, application and what is derived from a list of merges.

Training keeps the corpus as blobs of tokens, one row for some megabytes, compressed, with tokens as places in the list of the blob's
distinct ones, so that a byte each does for most. A step is one job: every blob takes the last merge and counts its pairs, in one vectorised
pass, and the counts are summed; the driver sees the best pair only. Lineage is cut in the shared folder."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import tokens as K
from corpusloom.functions.batches import slices
from corpusloom.operators.histograms import counted, flat, summed
from corpusloom.session import make_importable
from corpusloom.sources.tables import saved

STATE = "n bigint, blob binary, symbols binary, keys binary, counts binary"
BLOB_TOKENS = 1_000_000
#: Distinct tokens up to which pairs are counted in a table instead of by sorting.
TABLE_SYMBOLS = 1024
#: Rows of a vocabulary that is sent to all tasks at most.
MOST_BROADCAST = 1_000_000
Merge = tuple[int, int, int]


def collapse(x: np.ndarray, left: int, right: int, new: int) -> np.ndarray:
    """The trainer's merge over an array in which -1 separates sequences."""
    match = (x[:-1] == left) & (x[1:] == right)
    if not match.any():
        return x
    out = x.copy()
    out[:-1][match] = new
    stays = np.ones(len(x), bool)
    stays[1:] = ~match
    return out[stays]


def greedy(x: np.ndarray, left: int, right: int, new: int) -> np.ndarray:
    """The evaluator's merge, left to right without overlap."""
    match = np.flatnonzero((x[:-1] == left) & (x[1:] == right))
    if not len(match):
        return x
    if left == right:  # of a run of matches every second one
        first = np.concatenate([[True], np.diff(match) > 1])
        start = np.maximum.accumulate(np.where(first, np.arange(len(match)), 0))
        match = match[(np.arange(len(match)) - start) % 2 == 0]
    out = x.copy()
    out[match] = new
    return np.delete(out, match + 1)


def width(symbols: int) -> type:
    """The narrowest type for places in a list of so many."""
    return np.uint8 if symbols <= 1 << 8 else np.uint16 if symbols <= 1 << 16 else np.int32


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values of an array, in order; without sorting it where they lie close together."""
    lo, hi = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    if hi - lo >= 1 << 20:
        return np.unique(x).astype(np.int64)
    there = np.zeros(hi - lo + 1, bool)
    there[x - lo] = True
    return np.flatnonzero(there) + lo


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An array as places in the list of its distinct values, and that list."""
    symbols = distinct(x)
    kind = width(len(symbols))
    if not len(symbols) or symbols[-1] - symbols[0] >= 1 << 20:
        return np.searchsorted(symbols, x).astype(kind), symbols
    place = np.zeros(symbols[-1] - symbols[0] + 1, kind)
    place[symbols - symbols[0]] = np.arange(len(symbols))
    return place[x - symbols[0]], symbols


def collapse_coded(codes: np.ndarray, symbols: np.ndarray, left: int, right: int, new: int) -> tuple[np.ndarray, np.ndarray]:
    """collapse() of a coded array; the very same array comes back where the pair isn't in it."""
    at = [np.flatnonzero(symbols == x) for x in (left, right, new)]
    if not len(at[0]) or not len(at[1]):
        return codes, symbols
    grown = symbols if len(at[2]) else np.append(symbols, new)
    wide = codes.astype(width(len(grown)), copy=False)
    out = collapse(wide, at[0][0], at[1][0], at[2][0] if len(at[2]) else len(symbols))
    return (codes, symbols) if out is wide else (out, grown)


def histogram(codes: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of adjacent pairs of a coded array, both tokens valid."""
    k = len(symbols)
    if k > TABLE_SYMBOLS:
        v = symbols[codes]
        inside = (v[:-1] >= 0) & (v[1:] >= 0)
        return counted((v[:-1] << 32 | v[1:])[inside])
    pairs = codes[:-1].astype(np.int64)
    pairs *= k
    pairs += codes[1:]
    table = np.bincount(pairs, minlength=k * k)
    at = np.flatnonzero(table)
    left, right = symbols[at // k], symbols[at % k]
    inside = (left >= 0) & (right >= 0)
    return (left << 32 | right)[inside], table[at][inside]


def state_row(codes: np.ndarray, symbols: np.ndarray) -> tuple[int, bytes, bytes, bytes, bytes]:
    k, c = histogram(codes, symbols)
    return len(codes), pa.compress(codes.tobytes(), "zstd", asbytes=True), symbols.astype(np.int64).tobytes(), k.astype(np.int64).tobytes(), c.astype(np.int64).tobytes()


def blob_of(n: int, blob: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    known = np.frombuffer(symbols, np.int64)
    kind = np.dtype(width(len(known)))
    return np.frombuffer(pa.decompress(blob, n * kind.itemsize, "zstd", asbytes=True), kind), known


def as_state(row: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *(pa.array([x], pa.binary()) for x in row[1:])], names=["n", "blob", "symbols", "keys", "counts"])


def start(seqs: DataFrame, apply: list[Merge]) -> DataFrame:
    """The sequences as blobs, with merges applied and pairs counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def row() -> pa.RecordBatch:
            x = np.concatenate(held)
            held.clear()
            codes, symbols = coded(x)
            for m in apply:
                codes, symbols = collapse_coded(codes, symbols, *m)
            return as_state(state_row(codes, symbols))

        for b in slices(batches, 0, BLOB_TOKENS):
            values, bounds = flat(b.column(0))
            held.append(np.insert(values.astype(np.int32), bounds[1:], -1))
            if sum(map(len, held)) >= BLOB_TOKENS:
                yield row()
        if held:
            yield row()

    make_importable(seqs.sparkSession)
    return seqs.select("toks").mapInArrow(run, STATE)


def merged(state: DataFrame, merge: Merge) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = tuple(c[i].as_py() for c in b.columns)
                codes, symbols = blob_of(*row[:3])
                done, grown = collapse_coded(codes, symbols, *merge)
                yield as_state(state_row(done, grown) if done is not codes else row)  # a blob without the pair keeps its counts

    return state.mapInArrow(run, STATE)


def pair_counts(state: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, c = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            k = np.concatenate([k, *(np.frombuffer(x, np.int64) for x in b.column(0).to_pylist())])
            c = np.concatenate([c, *(np.frombuffer(x, np.int64) for x in b.column(1).to_pylist())])
            k, c = summed(k, c)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], names=["key", "cnt"])

    return state.select("keys", "counts").mapInArrow(run, "key bigint, cnt bigint").groupBy("key").agg(F.sum("cnt").alias("cnt"))


def train(
    seqs: DataFrame, merges: int, first_id: int = 256, min_count: int = 2, warm: list[tuple[int, int]] | None = None, freeze: bool = False, tie_seed: int | None = None,
    tie_breaker: Callable[[list[int]], int] | None = None, checkpoint_every: int = 16, on_step: Callable[[int, Merge, int], bool | None] | None = None,
) -> list[tuple[int, int, int, int, int]]:
    """Merges as (step, left, right, new_id, count), by a full count each step.

    The pair of highest count wins, the lowest key among equals (or what tie_seed or tie_breaker chooses); training stops when the best
    count is below min_count. warm pairs are applied first, in order; freeze keeps them from being chosen again. on_step may return
    False to stop."""
    out: list[tuple[int, int, int, int, int]] = []
    seen = list(dict.fromkeys(warm or []))[:merges]
    for i, (a, b) in enumerate(seen):
        out.append((i, a, b, first_id + i, 0))
    frozen = [a << 32 | b for a, b in seen] if freeze else []
    rng = random.Random(tie_seed)
    state = start(seqs, [(a, b, n) for _, a, b, n, _ in out]).persist()
    before = None
    try:
        for step in range(len(out), merges):
            counts = pair_counts(state).where(F.col("cnt") >= min_count)
            if frozen:
                counts = counts.where(~F.col("key").isin(frozen))
            if tie_seed is None and tie_breaker is None:
                best = counts.orderBy(F.desc("cnt"), "key").limit(1).collect()
            else:
                top = counts.agg(F.max("cnt")).first()[0]
                best = [] if top is None else counts.where(F.col("cnt") == top).orderBy("key").collect()
                if best:
                    keys = [r["key"] for r in best]
                    chosen = tie_breaker(keys) if tie_breaker else keys[rng.randrange(len(keys))]
                    best = [r for r in best if r["key"] == chosen]
            if not best:
                break
            key, cnt = best[0]["key"], best[0]["cnt"]
            merge = (key >> 32, key & 0xFFFFFFFF, first_id + step)
            if merge[2] > 0xFFFFFFFF:
                raise OverflowError("token id exceeds 32 bits")
            out.append((step, *merge, cnt))
            if on_step and on_step(step, merge, cnt) is False:
                break
            if step + 1 < merges:
                new = merged(state, merge)
                new = saved(new, "bpe") if (step + 1) % checkpoint_every == 0 else new.persist()
                if before is not None:
                    before.unpersist()
                before, state = state, new
    finally:
        state.unpersist()
        if before is not None:
            before.unpersist()
    return out


def applied(batches: Iterator[pa.RecordBatch], rules: list[Merge], how: str) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Ids, tokens after all rules with -1 behind each sequence, and the places of those, for slices of (id, sequence)."""
    step = {"greedy": greedy, "collapse": collapse}[how]
    for b in slices(batches, 1):
        values, bounds = flat(b.column(1))
        x = np.insert(values.astype(np.int64), bounds[1:], -1)
        present = set(distinct(x).tolist())
        for left, right, new in rules:
            if left in present and right in present:
                y = step(x, left, right, new)
                if y is not x:
                    present.add(new)
                    x = y
        yield b.column(0), x, np.flatnonzero(x == -1)


def apply(seqs: DataFrame, rules: list[Merge], how: str = "greedy") -> DataFrame:
    """Sequences with all rules applied in order, by the trainer's (collapse) or the evaluator's (greedy) meaning.

    Rules are a vocabulary, tens of thousands at most; a batch is one array, on which rules whose symbols it lacks are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, ends in applied(batches, rules, how):
            lengths = np.diff(ends, prepend=-1) - 1
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(x[x != -1].astype(np.int32)))], names=["doc_id", "toks"])

    make_importable(seqs.sparkSession)
    return seqs.select("doc_id", "toks").mapInArrow(run, "doc_id bigint, toks array<int>")


def totals(seqs: DataFrame, rules: list[Merge], how: str = "greedy") -> DataFrame:
    """(doc_id, n_tokens, token_sum) of what apply() returns, added up in the task, so that no sequence leaves a worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, ends in applied(batches, rules, how):
            sums = np.diff(np.cumsum(x)[ends], prepend=0) + 1  # without the -1
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(ends, prepend=-1) - 1), pa.array(sums)], names=["doc_id", "n_tokens", "token_sum"])

    make_importable(seqs.sparkSession)
    return seqs.select("doc_id", "toks").mapInArrow(run, "doc_id bigint, n_tokens bigint, token_sum bigint")


def table(spark: SparkSession, merges: list[tuple]) -> DataFrame:
    """Merges as a DataFrame (step, left, right, new_id)."""
    rows = [(i, *m[-4:-1]) if len(m) == 5 else (i, *m) for i, m in enumerate(merges)]
    return spark.createDataFrame(rows, "step int, left bigint, right bigint, new_id bigint")


def pieces(merges: list[Merge], base: dict[int, bytes] | None = None) -> dict[int, bytes]:
    """The bytes of each id: the base, and each merge's halves put together."""
    out = dict(base) if base is not None else {b: bytes([b]) for b in range(256)}
    for left, right, new in merges:
        out[new] = out[left] + out[right]
    return out


def strings(found: dict[int, bytes]) -> dict[int, str]:
    """Ids to tokens in the printable alphabet."""
    letters = K.alphabet()
    return {i: "".join(letters[b] for b in p) for i, p in found.items()}


def merge_lines(merges: list[Merge], names: dict[int, str]) -> list[str]:
    return [f"{names[a]} {names[b]}" for a, b, _ in merges]


def encode_text(docs: DataFrame, merges: list[Merge]) -> DataFrame:
    """(doc_id, toks) of texts (doc_id, text) by merges in order of rank: as long as no merge makes one of lower rank possible, which no
    trained list does, all places of a merge before the next one are what taking the lowest rank each time gives."""
    from corpusloom.operators.sequences import encode

    return apply(encode(docs), merges, "greedy")


def decode(seqs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, bytes) of sequences, by a join with pieces (id, piece), which are broadcast if they are few. Unknown ids have no bytes."""
    few = F.broadcast(found) if found.count() <= MOST_BROADCAST else found
    placed = seqs.select("doc_id", F.posexplode("toks").alias("pos", "id")).join(few, "id")
    parts = placed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.hex("piece").alias("h")))).alias("parts"))
    return parts.select("doc_id", F.unhex(F.array_join(F.transform("parts", lambda p: p["h"]), "")).alias("bytes"))


def ranks_from_vocab(vocab: DataFrame, special: list[str]) -> DataFrame:
    """(piece, rank) of a vocabulary (token, id) in the printable alphabet, special tokens left out."""
    return vocab.where(~F.col("token").isin(special)).select(K.string_piece(F.col("token")).alias("piece"), F.col("id").alias("rank"))


def merges_from_ranks(ranks: DataFrame) -> DataFrame:
    """(rank, left, right): for each longer piece its first split whose halves both have lower ranks."""
    long = ranks.where(F.octet_length("piece") > 1).select("rank", F.hex("piece").alias("h"))
    cut = long.select("rank", F.explode(F.sequence(F.lit(1), (F.length("h") / 2).cast("int") - 1)).alias("at"), "h")
    halves = cut.select("rank", "at", F.expr("unhex(substring(h, 1, at * 2))").alias("lp"), F.expr("unhex(substring(h, at * 2 + 1))").alias("rp"))
    lo = ranks.select(F.col("piece").alias("lp"), F.col("rank").alias("lr"))
    hi = ranks.select(F.col("piece").alias("rp"), F.col("rank").alias("rr"))
    both = halves.join(lo, "lp").join(hi, "rp").where("lr < rank and rr < rank")
    found = both.groupBy("rank").agg(F.min_by(F.struct("lr", "rr"), "at").alias("m"))
    checked = long.join(found, "rank", "left").withColumn("m", F.when(F.col("m").isNull(), F.raise_error(F.lit("a piece has no split of lower ranks"))).otherwise(F.col("m")))
    return checked.select("rank", F.col("m.lr").alias("left"), F.col("m.rr").alias("right"))
