"""Unigram vocabularies: candidates, expectation and maximisation, pruning, segmentation.

A vocabulary is tens of thousands of pieces at most and travels to the tasks; a sequence's lattice is one pass over its bytes."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.batches import slices
from corpusloom.operators import histograms
from corpusloom.session import make_importable

UNREACHABLE = -1e8


@dataclass
class Vocabulary:
    """Pieces by id, their log probabilities, and how many of the first ids are never pruned."""

    pieces: list[bytes]
    logp: list[float]
    base: int = 256
    history: list[dict] = field(default_factory=list)

    @staticmethod
    def of_bytes(pieces: list[bytes] | None = None) -> Vocabulary:
        start = pieces if pieces is not None else [bytes([b]) for b in range(256)]
        return Vocabulary(list(start), [-math.log(len(start))] * len(start), len(start))

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)

    def by_piece(self) -> dict[bytes, int]:
        return {p: i for i, p in reversed(list(enumerate(self.pieces)))}

    def state(self) -> dict:
        """For a checkpoint."""
        return {"pieces": [p.hex() for p in self.pieces], "logp": list(self.logp), "base": self.base, "history": list(self.history)}

    @staticmethod
    def from_state(state: dict) -> Vocabulary:
        return Vocabulary([bytes.fromhex(p) for p in state["pieces"]], [float(v) for v in state["logp"]], int(state["base"]), list(state["history"]))

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, bytearray(p), float(v)) for i, (p, v) in enumerate(zip(self.pieces, self.logp, strict=True))]
        return spark.createDataFrame(rows, "piece_id bigint, piece binary, logp double")


def byte_strings(column: pa.Array) -> list[bytes]:
    """The valid tokens of each sequence that are bytes."""
    values, bounds = histograms.flat(column)
    valid = (values >= 0) & (values < 256)
    data, ends = values[valid].astype(np.uint8).tobytes(), np.concatenate([[0], np.cumsum(valid)])[bounds].tolist()
    return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def edges(data: bytes, by_piece: dict[bytes, int], longest: int) -> list[list[tuple[int, int]]]:
    """For each place the pieces that end there, as (start, id)."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(data) + 1)]
    for start in range(len(data)):
        for end in range(start + 1, min(len(data), start + longest) + 1):
            i = by_piece.get(data[start:end])
            if i is not None:
                out[end].append((start, i))
    return out


def expectation(data: bytes, by_piece: dict[bytes, int], logp: np.ndarray, longest: int) -> tuple[float, dict[int, float]]:
    """log Z and expected counts of a byte string; where no segmentation reaches its end, counts of its raw bytes."""
    n = len(data)
    if not n:
        return 0.0, {}
    into = edges(data, by_piece, longest)
    ahead = [UNREACHABLE * 10] * (n + 1)
    ahead[0] = 0.0
    for end in range(1, n + 1):
        scores = [ahead[s] + logp[i] for s, i in into[end]]
        if scores:
            most = max(scores)
            ahead[end] = most + math.log(sum(math.exp(x - most) for x in scores))
    if ahead[n] < UNREACHABLE:
        counts: dict[int, float] = {}
        for b in data:
            counts[b] = counts.get(b, 0.0) + 1.0
        return ahead[n], counts
    behind = [UNREACHABLE * 10] * (n + 1)
    behind[n] = 0.0
    counts = {}
    for end in range(n, 0, -1):
        for s, i in into[end]:
            x = logp[i] + behind[end]
            high, low = max(behind[s], x), min(behind[s], x)
            behind[s] = high + math.log1p(math.exp(low - high))
            p = ahead[s] + x - ahead[n]
            if p > -60:
                counts[i] = counts.get(i, 0.0) + math.exp(p)
    return ahead[n], counts


def best_path(data: bytes, by_piece: dict[bytes, int], logp: np.ndarray, longest: int, otherwise: object = bytes) -> list[int]:
    """The likeliest segmentation as ids; lower ids among equals; raw bytes, or otherwise, where none reaches the end."""
    score, back = [0.0] + [-math.inf] * len(data), [(-1, -1)] * (len(data) + 1)
    for end, found in enumerate(edges(data, by_piece, longest)):
        for s, i in sorted(found, key=lambda x: x[1]):
            if score[s] + logp[i] > score[end]:
                score[end], back[end] = score[s] + logp[i], (s, i)
    if score[-1] == -math.inf:
        return list(data) if otherwise is bytes else otherwise
    out, at = [], len(data)
    while at:
        at, i = back[at]
        out.append(i)
    return out[::-1]


class Lattice:
    """The pieces that many byte strings contain, found by vectors, and where their lattices come apart.

    A place inside no piece is one that every path goes through: what lies between two such places is a segment, which is worked for
    itself, once for all its occurrences. Segments that have been worked are kept, up to a number of them."""

    KEPT = 200_000

    def __init__(self, vocab: Vocabulary) -> None:
        self.by_piece, self.logp, self.longest = vocab.by_piece(), np.array(vocab.logp), vocab.longest
        self.single = np.full(256, -1, np.int64)
        codes: dict[int, list[int]] = {}
        for piece, i in self.by_piece.items():
            if len(piece) == 1:
                self.single[piece[0]] = i
            elif piece:
                codes.setdefault(len(piece), []).append(self.code(piece))
        self.codes = {n: np.unique(np.array(c, np.uint64)) for n, c in codes.items()}
        self.counted: dict[bytes, dict[int, float] | None] = {}
        self.best: dict[bytes, list[int] | None] = {}

    @staticmethod
    def code(piece: bytes) -> int:
        """A polynomial in its bytes, modulo 2**64; up to 8 bytes no two are equal."""
        out = 0
        for b in piece:
            out = (out * 256 + b if len(piece) <= 8 else out * MULTIPLIER + b) & 0xFFFFFFFFFFFFFFFF
        return out

    def cuts(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The ends of all segments of byte strings one after another, which end at ends."""
        spanned = np.zeros(len(data) + 1, np.int64)
        left = np.repeat(ends, np.diff(np.concatenate([[0], ends]))) - np.arange(len(data))  # bytes up to the string's end
        for n, known in self.codes.items():
            if len(data) < n:
                continue
            code = np.zeros(len(data) - n + 1, np.uint64)
            for k in range(n):
                code *= np.uint64(256 if n <= 8 else MULTIPLIER)
                code += data[k : len(data) - n + 1 + k]
            at = np.minimum(np.searchsorted(known, code), len(known) - 1)
            start = np.flatnonzero((known[at] == code) & (left[: len(code)] >= n))
            np.add.at(spanned, start + 1, 1)
            np.add.at(spanned, start + n, -1)
        whole = np.cumsum(spanned) == 0
        whole[ends] = True
        whole[0] = False
        return np.flatnonzero(whole)

    def counts(self, segment: bytes) -> dict[int, float] | None:
        """Expected counts in a segment; None where no path reaches its end."""
        if segment not in self.counted:
            if len(self.counted) >= self.KEPT:
                self.counted.clear()
            z, found = expectation(segment, self.by_piece, self.logp, self.longest)
            self.counted[segment] = found if z >= UNREACHABLE else None
        return self.counted[segment]

    def path(self, segment: bytes) -> list[int] | None:
        if segment not in self.best:
            if len(self.best) >= self.KEPT:
                self.best.clear()
            self.best[segment] = best_path(segment, self.by_piece, self.logp, self.longest, None)
        return self.best[segment]

    def segments(self, texts: list[bytes]) -> list[list[bytes]]:
        """The segments of each text."""
        data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        cuts = self.cuts(data, ends[np.diff(ends, prepend=0) > 0]) if len(data) else np.empty(0, np.int64)
        raw, out, at = b"".join(texts), [], 0
        bounds = np.searchsorted(cuts, ends, side="right").tolist()
        places = cuts.tolist()
        k = 0
        for hi in bounds:
            found = []
            for end in places[k:hi]:
                found.append(raw[at:end])
                at = end
            k = hi
            out.append(found)
        return out


MULTIPLIER = 0x9E3779B97F4A7C15


def expected(seqs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(piece_id, exp_count) over all sequences. A task sums its own; a segment that occurs often is worked once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, total = Lattice(vocab), np.zeros(len(vocab.pieces))
        raw = np.zeros(256)  # where a sequence has no path, its bytes count as the ids that they are
        for b in slices(batches, 0):
            texts = byte_strings(b.column(0))
            times: Counter[bytes] = Counter()
            for text, found in zip(texts, lattice.segments(texts), strict=True):
                if any(lattice.counts(x) is None for x in set(found)):
                    raw += np.bincount(np.frombuffer(text, np.uint8), minlength=256)
                else:
                    times.update(found)
            for segment, n in times.items():
                for i, c in lattice.counts(segment).items():
                    total[i] += n * c
        size = max(256, len(total))
        total = np.pad(total, (0, size - len(total))) + np.pad(raw, (0, size - 256))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["piece_id", "exp_count"])

    make_importable(seqs.sparkSession)
    return seqs.select("toks").mapInArrow(run, "piece_id bigint, exp_count double").groupBy("piece_id").agg(F.sum("exp_count").alias("exp_count"))


def segment(seqs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(doc_id, toks) of the likeliest pieces; raw bytes where no path reaches the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocab)
        for b in slices(batches, 1):
            texts, done = byte_strings(b.column(1)), []
            for text, found in zip(texts, lattice.segments(texts), strict=True):
                paths = [lattice.path(x) for x in found]
                done.append(list(text) if None in paths else [i for p in paths for i in p])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.list_(pa.int32()))], names=["doc_id", "toks"])

    make_importable(seqs.sparkSession)
    return seqs.select("doc_id", "toks").mapInArrow(run, "doc_id bigint, toks array<int>")


def candidates(seqs: DataFrame, longest: int, known: DataFrame | None = None) -> DataFrame:
    """(gram, n, cnt) of byte strings of 2 to longest bytes that are no pieces yet; known: grams (gram array<int>)."""
    grams = histograms.ngrams(seqs, 2, longest)
    return grams if known is None else grams.join(known.select("gram"), "gram", "left_anti")


def ranked(found: DataFrame, longest: int, room: int) -> DataFrame:
    """The first candidates by falling count, then by the little-endian number of their bytes and length; one at least."""
    number = F.lpad(F.array_join(F.transform(F.reverse("gram"), lambda x: F.lpad(F.hex(x.cast("bigint")), 2, "0")), ""), 2 * longest, "0")
    return found.withColumn("number", number).orderBy(F.desc("cnt"), "number", "n").limit(max(room, 1))


def mstep(counts: DataFrame) -> DataFrame:
    """(piece_id, exp_count) with log probabilities; counts are smoothed, probabilities clamped."""
    total = counts.agg(F.sum(F.col("exp_count") + 1e-6).alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("piece_id", F.log(F.greatest((F.col("exp_count") + 1e-6) / F.col("total"), F.lit(1e-12))).alias("logp"))


def pruned(pieces: DataFrame, target: int, base: int) -> DataFrame:
    """Pieces (piece_id, piece, exp_count) without the least counted ones beyond target, renumbered; the first base ids stay."""
    size = pieces.count()
    spare = pieces.where(F.col("piece_id") >= base).orderBy(F.round("exp_count", 9), "piece_id").limit(max(0, size - target)).select("piece_id")
    kept = pieces.join(F.broadcast(spare), "piece_id", "left_anti")
    return kept.withColumn("new_id", F.row_number().over(Window.orderBy("piece_id")) - 1)  # a vocabulary, not a corpus


def epoch(seqs: DataFrame, vocab: Vocabulary, target: int, longest: int, scope: str = "first_batch", batch_size: int = 32) -> Vocabulary:
    """One round: new candidates while there is room, expectation, maximisation, pruning."""
    pieces, logp = list(vocab.pieces), list(vocab.logp)
    if len(pieces) < target:
        source = seqs.orderBy("doc_id").limit(batch_size) if scope == "first_batch" else seqs
        known = seqs.sparkSession.createDataFrame([(list(p),) for p in pieces if len(p) > 1] or [([-1],)], "gram array<int>")
        new = [bytes(r["gram"]) for r in ranked(candidates(source, longest, known), longest, target - len(pieces)).collect()]
        if new:
            pieces += new
            logp = [-math.log(len(pieces))] * len(pieces)
    grown = Vocabulary(pieces, logp, vocab.base, vocab.history)
    counts = np.zeros(len(pieces))
    for r in expected(seqs, grown).collect():  # a row for each piece
        counts[r["piece_id"]] = r["exp_count"]
    added = len(pieces) - len(vocab.pieces)
    if len(pieces) > target:
        spare = sorted(range(vocab.base, len(pieces)), key=lambda i: (round(counts[i], 9), i))[: len(pieces) - target]
        keep = [i for i in range(len(pieces)) if i not in set(spare)]
        pieces, counts = [pieces[i] for i in keep], counts[keep]
    p = np.maximum((counts + 1e-6) / (counts + 1e-6).sum(), 1e-12)
    record = {"added": added, "size": len(pieces), "expected": float(counts.sum())}
    return Vocabulary(pieces, np.log(p).tolist(), vocab.base, [*vocab.history, record])


def fit(seqs: DataFrame, epochs: int, target: int, longest: int = 8, start: Vocabulary | None = None, scope: str = "first_batch", batch_size: int = 32, deadline=None, on_epoch=None) -> Vocabulary:
    """Several epochs, those of start included; deadline() true ends training between them, and on_epoch(vocabulary) follows each."""
    vocab = start or Vocabulary.of_bytes()
    for _ in range(len(vocab.history), epochs):
        if deadline and deadline():
            break
        vocab = epoch(seqs, vocab, target, longest, scope, batch_size)
        if on_epoch:
            on_epoch(vocab)
    return vocab


def probabilities(vocab: DataFrame) -> DataFrame:
    """(piece_id, piece, prob): the softmax of log probabilities."""
    total = vocab.agg(F.sum(F.exp("logp")).alias("z"))
    return vocab.crossJoin(F.broadcast(total)).select("piece_id", "piece", (F.exp("logp") / F.col("z")).alias("prob"))
