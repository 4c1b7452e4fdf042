"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are runs of letters and digits, in lower case. A token's evidence is what its word and its beginnings of several lengths say:
the log odds of each among toxic and other labelled documents. Labelled tokens come of labelled documents: a token of a toxic document
whose evidence is strong is toxic. The field has two states, weights for the evidence and for transitions, fitted by gradient on the
likelihood of the labelled tokens; forward-backward gives every token's marginal, and a logistic model on their sum and maximum gives
the document's score. It is fitted on a bounded sample of labelled rows (max_rows, max_bytes, max_tokens); scoring covers all rows and
whole texts.

Forward-backward over many documents at once: every token is a 2 x 2 matrix, which at a document's first token forgets the state before
it; blocks of tokens are multiplied side by side, the blocks' products one after the other, then the blocks are gone through again.

Defined cases: null and empty texts, and texts without tokens, have the score of no evidence; without labels of both kinds every
score is 0; an empty table gives no rows; repeated rows give repeated results; a null doc_id stays null and is never learned
from; labels that contradict each other count as toxic; other columns are ignored."""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .base import id_and_text, ready, slices_of, text_slices

#: Bytes that no token has: ASCII but for letters and digits.
BREAK = np.array([b < 128 and not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122) for b in range(256)])
BEGINNINGS = (4, 5, 6, 7, 8)
LEVELS = (1.5, 2.5, 4.0)  # log odds from which evidence counts as weak, fair and strong
STRONG = 2.5
BLOCK = 64
SLICE = 1_000_000
_BREAK = re.compile(rb"[\x00-/:-@\[-`{-\x7f]")


def lowered(text: str) -> bytes:
    """In lower case; where that would move bytes, only A-Z."""
    raw, low = text.encode(), text.lower().encode()
    return low if len(low) == len(raw) else raw.translate(H.LOWER)


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Bounds of the texts in tokens, each token's start and end in bytes of its text, its word hash and those of its beginnings."""
    return raw_tokens([lowered(t) for t in texts])


def raw_tokens(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """tokens() of texts in lower case."""
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    off = BREAK[data]
    change = np.flatnonzero(off[1:] != off[:-1]) + 1
    start, end = change[::2], change[1::2]
    at = 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in raw], dtype=np.int64)])
    bounds = np.searchsorted(start, at)
    sums = H.prefix(H.BYTE_SYMBOLS[data])
    word = H.windows(sums, start, end)
    begin = [H.windows(sums, start, np.minimum(start + n, end)) + H.U(n) for n in BEGINNINGS]
    offset = np.repeat(at[:-1], np.diff(bounds))
    return bounds, start - offset, end - offset, word, begin


def slices(raw: list[bytes], size: int = SLICE) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts with their numbers, about size bytes at once; a longer text comes as several, cut where no token is."""
    numbers, held, total = [], [], 0
    for i, text in enumerate(raw):
        at = 0
        while at < len(text) or not text:
            gap = _BREAK.search(text, at + size - 1) if len(text) - at > size else None
            end = gap.end() if gap else len(text)
            numbers.append(i)
            held.append(text[at:end])
            total += end - at
            if total >= size or len(held) >= 200:
                yield numbers, held
                numbers, held, total = [], [], 0
            at = end
            if not text:
                break
    if held:
        yield numbers, held


@dataclass
class Lexicon:
    """Evidence by hash: sorted hashes and their levels, for words and for beginnings."""

    word: tuple[np.ndarray, np.ndarray]
    begin: tuple[np.ndarray, np.ndarray]

    @staticmethod
    def look(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> np.ndarray:
        keys, levels = table
        if not len(keys):
            return np.zeros(len(hashes), np.int64)
        i = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[i] == hashes, levels[i], 0)

    def evidence(self, word: np.ndarray, begin: list[np.ndarray]) -> np.ndarray:
        """0 to 15: the word's level and the highest of its beginnings'."""
        best = np.zeros(len(word), np.int64)
        for b in begin:
            np.maximum(best, self.look(self.begin, b), out=best)
        return self.look(self.word, word) * 4 + best


@dataclass
class Model:
    lexicon: Lexicon
    emission: np.ndarray  # by evidence, what state 1 has over state 0
    transition: np.ndarray  # by state before and state
    score: np.ndarray  # weights of the document's features, the last one constant

    def marginals(self, evidence: np.ndarray, first: np.ndarray) -> np.ndarray:
        return marginals(np.exp(self.emission)[evidence], np.exp(self.transition), first)[0]

    def scores(self, marginal: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-features(marginal, bounds) @ self.score))


def marginals(weight: np.ndarray, transition: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's probability of state 1, and the sums over tokens of pair probabilities (state before, state).

    weight: state 1's over state 0's; first: True for the first token of a document, whose states before are equally likely."""
    n = len(weight)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    blocks = -(-n // BLOCK)
    m = np.empty((blocks * BLOCK, 2, 2))
    m[:n] = transition
    m[:n][first] = 1.0
    m[:n, :, 1] *= weight[:, None]
    m[n:] = np.eye(2)
    m /= m.sum(axis=(1, 2), keepdims=True)
    m = m.reshape(blocks, BLOCK, 2, 2)
    whole = m[:, 0].copy()
    for i in range(1, BLOCK):
        whole = np.einsum("bij,bjk->bik", whole, m[:, i])
        whole /= whole.sum(axis=(1, 2), keepdims=True)
    ahead, behind = np.empty((blocks, 2)), np.empty((blocks, 2))
    a, b = np.full(2, 0.5), np.full(2, 0.5)
    for k in range(blocks):
        ahead[k] = a
        a = a @ whole[k]
        a = a / a.sum()
    for k in range(blocks - 1, -1, -1):
        behind[k] = b
        b = whole[k] @ b
        b = b / b.sum()
    forward, backward = np.empty((blocks, BLOCK, 2)), np.empty((blocks, BLOCK, 2))
    before = np.empty((blocks, BLOCK, 2))
    for i in range(BLOCK):
        before[:, i] = ahead
        ahead = np.einsum("bi,bij->bj", ahead, m[:, i])
        ahead /= ahead.sum(axis=1, keepdims=True)
        forward[:, i] = ahead
    for i in range(BLOCK - 1, -1, -1):
        backward[:, i] = behind
        behind = np.einsum("bij,bj->bi", m[:, i], behind)
        behind /= behind.sum(axis=1, keepdims=True)
    both = (forward * backward).reshape(-1, 2)[:n]
    pairs = (before[..., :, None] * m * backward[..., None, :]).reshape(-1, 2, 2)[:n]
    pairs = pairs / pairs.sum(axis=(1, 2), keepdims=True)
    return both[:, 1] / both.sum(axis=1), pairs[~first].sum(axis=0)


def features(marginal: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each document: the logarithm of the expected toxic tokens, the highest marginal, their density, and 1."""
    n = np.diff(bounds)
    some = n > 0
    out = np.zeros((len(n), 4))
    out[:, 3] = 1
    if some.any():
        total = np.add.reduceat(marginal, bounds[:-1][some])
        out[some, 0] = np.log1p(total)
        out[some, 1] = np.maximum.reduceat(marginal, bounds[:-1][some])
        out[some, 2] = 10 * total / (n[some] + 20)
    return out


def once(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash of a document once, in order of hashes."""
    order = np.lexsort((doc, hashes))
    h, d = hashes[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], d[new]


def drawn(lengths: np.ndarray, places: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each document the start and the length of a run of tokens, most together: all of short ones and equally many of the others,
    which start where the hashes in places say."""
    low, high = 1, max(1, int(lengths.max(initial=1)))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if np.minimum(lengths, middle).sum() <= most else (low, middle - 1)
    n = np.minimum(lengths, low)
    return places % (lengths - n + 1), n


@dataclass
class Counts:
    """How many toxic and how many other documents have each hash. Pairs of hash and document wait until there are enough of them, so
    that memory is for the distinct hashes, and for those of one document."""

    toxic: np.ndarray
    most: int = 1_000_000

    def __post_init__(self) -> None:
        self.hashes, self.yes, self.no = np.empty(0, H.U), np.empty(0, np.int64), np.empty(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, hashes: np.ndarray, doc: np.ndarray) -> None:
        """Documents come in order of their numbers; the last one may go on."""
        self.waiting.append(once(hashes, doc))
        if sum(len(h) for h, _ in self.waiting) > self.most:
            self.settle(int(doc.max(initial=0)))

    def settle(self, before: int | None = None) -> None:
        """Counts what waits, of documents before a number."""
        if not self.waiting:
            return
        h, d = once(*(np.concatenate(x) for x in zip(*self.waiting, strict=True)))
        done = np.ones(len(d), bool) if before is None else d < before
        self.waiting = [(h[~done], d[~done])]
        t = self.toxic[d[done]].astype(np.int64)
        hashes, yes, no = np.concatenate([self.hashes, h[done]]), np.concatenate([self.yes, t]), np.concatenate([self.no, 1 - t])
        order = np.argsort(hashes, kind="stable")
        start = H.group_starts(hashes[order])
        if len(start):
            self.hashes, self.yes, self.no = hashes[order][start], np.add.reduceat(yes[order], start), np.add.reduceat(no[order], start)

    def log_odds(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Of hashes that at least so many toxic documents have, those with evidence and its level."""
        self.settle()
        odds = np.log((self.yes + 0.5) / (self.toxic.sum() + 1)) - np.log((self.no + 0.5) / ((~self.toxic).sum() + 1))
        level = np.searchsorted(LEVELS, odds, side="right")
        keep = (self.yes >= least) & (level > 0)
        return self.hashes[keep], level[keep]


def train(texts: list[str], labels: list[int], rounds: int = 80, max_tokens: int = 150_000) -> Model | None:
    """A model of labelled texts; None without texts of both kinds.

    The lexicon and the documents' score are fitted on all of them and on whole texts, the field on max_tokens tokens:
    a run of each text, equally long but for shorter texts."""
    toxic = np.array(labels, bool)
    if not toxic.any() or toxic.all():
        return None
    turn = np.argsort(np.where(toxic, np.cumsum(toxic), np.cumsum(~toxic)), kind="stable")
    texts, toxic = [texts[i] for i in turn], toxic[turn]
    raw = [lowered(t) for t in texts]
    counts = [Counts(toxic) for _ in range(1 + len(BEGINNINGS))]
    for numbers, held in slices(raw):
        at, _, _, word, begin = raw_tokens(held)
        doc = np.repeat(np.array(numbers, np.int64), np.diff(at))
        for c, hashes in zip(counts, [word, *begin], strict=True):
            c.add(hashes, doc)
    tables = [c.log_odds(4) for c in counts[1:]]
    keys, levels = np.concatenate([k for k, _ in tables]), np.concatenate([v for _, v in tables])
    order = np.argsort(keys)
    lexicon = Lexicon(counts[0].log_odds(3), (keys[order], levels[order]))
    del counts
    lengths, parts = np.zeros(len(raw), np.int64), []
    for numbers, held in slices(raw):
        at, _, _, word, begin = raw_tokens(held)
        np.add.at(lengths, numbers, np.diff(at))
        parts.append(lexicon.evidence(word, begin).astype(np.uint8))
    evidence, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum(lengths)])
    start, taken = drawn(lengths, np.array([zlib.crc32(t) for t in raw], np.int64), max_tokens)
    n = int(taken.sum())
    before = np.cumsum(taken) - taken
    e = evidence[np.repeat(bounds[:-1] + start - before, taken) + np.arange(n)].astype(np.int64)
    y = ((np.maximum(e // 4, e % 4) >= 1 + LEVELS.index(STRONG)) & np.repeat(toxic, taken)).astype(np.int64)
    f = np.zeros(n, bool)
    f[before[taken > 0]] = True
    seen = np.bincount(e, weights=y, minlength=16)
    inner = np.flatnonzero(~f)
    pair_seen = np.bincount(y[inner - 1] * 2 + y[inner], minlength=4).reshape(2, 2).astype(float)
    model = Model(lexicon, np.full(16, -3.0), np.zeros((2, 2)), np.zeros(4))
    m1 = [np.zeros(16), np.zeros((2, 2))]
    m2 = [np.zeros(16), np.zeros((2, 2))]
    for r in range(1, rounds + 1):  # Adam on the log likelihood, with a quadratic penalty
        p, pairs = marginals(np.exp(model.emission)[e], np.exp(model.transition), f)
        grads = [(seen - np.bincount(e, weights=p, minlength=16) - 0.1 * model.emission) / n, (pair_seen - pairs - 0.1 * model.transition) / n]
        for k, (value, g) in enumerate(zip((model.emission, model.transition), grads, strict=True)):
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            value += 0.15 * (m1[k] / (1 - 0.9**r)) / (np.sqrt(m2[k] / (1 - 0.99**r)) + 1e-12)
    x, at = [], 0
    while at < len(raw):  # whole documents, some hundred thousand tokens at once
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE // 4, side="right")) - 1)
        own = bounds[at : end + 1] - bounds[at]
        first = np.zeros(own[-1], bool)
        first[own[:-1][np.diff(own) > 0]] = True
        x.append(features(model.marginals(evidence[bounds[at] : bounds[end]], first), own))
        at = end
    x = np.concatenate(x)
    for _ in range(30):  # Newton's steps of a logistic regression
        p = 1 / (1 + np.exp(-x @ model.score))
        w = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * w[:, None]).T @ x + 0.05 * np.eye(4), x.T @ (toxic - p) - 0.05 * model.score)
        model.score = model.score + np.clip(step, -3, 3)
    return model


SCHEMA = "doc_id long, score double, spans array<struct<start:long,end:long,marginal:double>>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())])))])


def spans(marginal: np.ndarray, bounds: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[list[dict]]:
    """Of each document the runs of tokens that are likelier toxic than not, in bytes of its text."""
    out: list[list[dict]] = [[] for _ in range(len(bounds) - 1)]
    hot = np.flatnonzero(marginal >= 0.5)
    doc = np.searchsorted(bounds, hot, side="right") - 1
    previous = None
    for i, d in zip(hot.tolist(), doc.tolist(), strict=True):
        if previous == (i - 1, d):
            out[d][-1] = {"start": out[d][-1]["start"], "end": int(end[i]), "marginal": max(out[d][-1]["marginal"], float(marginal[i]))}
        else:
            out[d].append({"start": int(start[i]), "end": int(end[i]), "marginal": float(marginal[i])})
        previous = (i, d)
    return out


def tagger(model: Model | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_slices(batches, 1_000_000):
            if model is None:
                columns = [0.0] * len(keys), [[] for _ in keys]
            else:
                bounds, start, end, word, begin = tokens(texts)
                first = np.zeros(len(word), bool)
                first[bounds[:-1][np.diff(bounds) > 0]] = True
                m = model.marginals(model.lexicon.evidence(word, begin), first)
                columns = model.scores(m, bounds), spans(m, bounds, start, end)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(columns[0], pa.float64()), pa.array(columns[1], _ARROW.field("spans").type)], schema=_ARROW)

    return run


def fit_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, toxic), all of them in one task, to a row with the pickled model."""
    rows = sorted({(i, t, y) for b in batches for i, t, y in zip(*(c.to_pylist() for c in b.columns), strict=True)})
    model = train([t for _, t, _ in rows], [int(y > 0) for _, _, y in rows])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def fitted(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, max_bytes: int = 32 << 20) -> Model | None:
    """A model of labelled rows whose crc32(doc_id) mod 4 is not 2: those of least hash, max_rows at most and of max_bytes of text together.

    Texts are taken whole: a document that would go beyond max_bytes is passed over. One task fits the model, whose size depends on
    these two bounds; the driver gets numbers of bytes and the model. Rows that repeat a document and its text count once."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    seen = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2
    chosen = known.where(seen).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = id_and_text(docs)
    sizes = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.sum(F.octet_length("text")).alias("bytes")).withColumn("place", F.xxhash64("doc_id"))
    taken, room = [], max_bytes
    for r in sorted(sizes.collect(), key=lambda r: (r["place"], r["doc_id"])):  # max_rows at most
        if r["bytes"] <= room:
            room -= r["bytes"]
            taken.append((r["doc_id"], r["toxic"]))
    if not taken:
        return None
    few = docs.sparkSession.createDataFrame(taken, "doc_id long, toxic int")
    sample = rows.join(F.broadcast(few), "doc_id").select("doc_id", "text", "toxic")
    found = sample.repartition(1).mapInArrow(fit_here, "model binary").first()
    return pickle.loads(found["model"]) if found else None


def tag(docs: DataFrame, model: Model | None) -> DataFrame:
    """A row for each document: its score and its toxic spans."""
    return id_and_text(docs).mapInArrow(tagger(model), SCHEMA)


def clean(docs: DataFrame, model: Model | None, threshold: float) -> DataFrame:
    """The rows, with all their columns, whose score is below the threshold."""
    names = docs.columns
    if model is None:
        return docs
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in slices_of(b, at, 1_000_000):
                bounds, _, _, word, begin = tokens([t or "" for t in x.column(at).to_pylist()])
                first = np.zeros(len(word), bool)
                first[bounds[:-1][np.diff(bounds) > 0]] = True
                m = model.marginals(model.lexicon.evidence(word, begin), first)
                yield x.filter(pa.array(model.scores(m, bounds) < threshold))

    ready(docs.sparkSession)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # mapInArrow takes no names with dots or backticks
    return plain.mapInArrow(run, plain.schema).toDF(*names)
