"""Near-duplicate documents by a join of parity sketches of their shingle sets.

1. A document's set holds the hashes of its shingles. Documents with equal sets are one class.
2. Sets of similarity t or more differ in at most (1 - t) / t * n shingles, n being the size of either. A sketch deals a set into
   parts, a power of two near its size band, and keeps the XOR of each part's hashes: a differing shingle spoils one part at most, so
   that of s non-empty parts s - k agree. Under one order of all parts two such sets share one among the first k + 1 of each; the
   order puts parts with rare shingles first, by counters of all shingles in a table of fixed size, so that common passages don't meet.
3. Classes that share a part are a family, named by the one that meets most others, its head. All are compared with the head first;
   what is linked then is one component, and only classes of a family that are still apart are compared after that, in blocks. A
   comparison bounds the symmetric difference from below by the Hamming distance of parity bits; what that leaves is decided by the
   sets themselves. Rows are members of families, never pairs.
4. The components of all links are the result.

Defined cases: null and empty texts, and those of white space alone, have no set, no links and themselves as component; fewer words than a
shingle make one shingle; repeated rows are members of one class; an empty table gives no rows; a null doc_id is never the name of a
component with others; other columns are ignored. No group of equal or similar documents is ever expanded into its pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .base import few, id_and_text, partitions, saved, text_slices
from .components import components

SLICE = 1_000_000
FLUSH = 1_000_000
#: The counters of shingles: as many as this, however large the corpus.
COUNTERS_LOG2, CHUNKS = 20, 16
SIGN = np.dtype([("sign", "u8"), ("cls", "i8")])
#: What a part has that so many classes of one batch share: it is known to be shared, and not sent to one partition.
HEAVY = 64


@dataclass(frozen=True)
class Similarity:
    """Sets A and B link when den * |A and B| >= num * |A or B|; sets of shingles of so many words."""

    shingle: int = 5
    num: int = 80
    den: int = 100

    def spoiled(self, n: int) -> int:
        """How many elements a set of n and a linked one differ in at most."""
        return n * (self.den - self.num) // self.num

    def linked(self, common: int, a: int, b: int) -> bool:
        return self.den * common >= self.num * (a + b - common)


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles."""
    hashes, bounds, _, _ = H.words([t.encode().translate(H.LOWER) for t in texts])
    sums = H.prefix(hashes)
    full = H.all_windows(sums, size)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(full[a : b - size + 1]))
        else:
            out.append(H.windows(sums, np.array([a] * (b > a), dtype=np.int64), np.array([b] * (b > a), dtype=np.int64)))
    return out


def class_of(s: np.ndarray) -> int:
    """A name of a set: one for equal sets."""
    return int(H.mix(np.array([H.mix(s + H.U(0x5851F42D4C957F2D)).sum(dtype=H.U) + H.U(len(s))]))[0].astype(np.int64))


def signs(s: np.ndarray, counters: np.ndarray, how: Similarity) -> np.ndarray:
    """The first parts of a set's sketches, as 64-bit values, for every size band in which it can have a partner."""
    n = len(s)
    k, band = how.spoiled(n), n.bit_length() - 1
    common = counters[(s >> H.U(64 - COUNTERS_LOG2)).astype(np.int64)]
    value = H.mix(s)
    out = []
    for g in [band, band + 1] if n * how.den >= how.num << (band + 1) else [band]:
        level = 0
        while True:
            parts = 1 << (g + 1 + level)
            part = s & H.U(parts - 1)
            order = np.argsort(part, kind="stable")
            first = H.group_starts(part[order])
            xor = np.bitwise_xor.reduceat(value[order], first)
            rare = np.minimum.reduceat(common[order], first)
            own = H.mix(xor + part[order][first] * H.U(0x9E3779B97F4A7C15) + H.U((g << 8) + level))
            if len(own) > k + 1:
                own = own[np.lexsort((own, rare))[: k + 1]]
            out.append(own)
            if len(first) > k:  # else parts are too few to be sure of a common one: finer ones as well
                break
            level += 1
    return np.concatenate(out)


SURVEY = "doc_id long, key long, n long, cls long, sketch binary, chunk int, counts binary"


def survey(how: Similarity) -> Callable:
    """Each document's class, set size and, once in a task, sketch; and, from each task, its counts of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTERS_LOG2, np.uint32)
        names = ["doc_id", "key", "n", "cls", "sketch", "chunk", "counts"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
        seen: set[int] = set()
        for ids, texts, keys in text_slices(batches, SLICE, True):
            sets = shingle_sets(texts, how.shingle)
            counts += np.bincount((np.concatenate(sets) >> H.U(64 - COUNTERS_LOG2)).astype(np.int64), minlength=len(counts)).astype(np.uint32)
            classes = [class_of(s) if len(s) else None for s in sets]
            drawn = []
            for c, s in zip(classes, sets, strict=True):
                drawn.append(None if c is None or c in seen else parity(s))
                seen.add(c)
            none = [None] * len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([ids, keys, [len(s) for s in sets], classes, drawn, none, none], kinds, strict=True)], names=names)
        if counts.any():
            none = [None] * CHUNKS
            columns = [none, none, none, none, none, range(CHUNKS), [c.tobytes() for c in counts.reshape(CHUNKS, -1)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return run


def add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of counts by chunk, of one partition's rows."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for chunk, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            values = np.frombuffer(counts, np.uint32).astype(np.uint64)
            total[chunk] = np.minimum(total[chunk] + values, 0xFFFFFFFF) if chunk in total else values
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.astype(np.uint32).tobytes() for v in total.values()], pa.binary())], names=["chunk", "counts"])


def sketch(how: Similarity, counters, parts: int) -> Callable:
    """The signs of each class of a task, packed, to the partition of the sign. A sign that many classes of a batch share is known to be
    shared: its rows are dealt out by class, and one of them goes to the sign's partition, so that it meets what other tasks have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.frombuffer(counters.value, np.uint32)
        held: list[np.ndarray] = []
        seen: set[int] = set()

        def dealt(r: np.ndarray, part: np.ndarray, shared: bool) -> pa.RecordBatch:
            order = np.argsort(part, kind="stable")
            r, part = r[order], part[order]
            first = H.group_starts(part)
            blobs = [b"".join(np.ascontiguousarray(r[f][a:b]).tobytes() for f in SIGN.names) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(r)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(part[first], pa.int32()), pa.array([shared] * len(first), pa.bool_()), pa.array(blobs, pa.binary())], names=["part", "shared", "blob"])

        def flush() -> Iterator[pa.RecordBatch]:
            r = np.concatenate(held)
            held.clear()
            seen.clear()
            order = np.argsort(r["sign"], kind="stable")
            first = H.group_starts(r["sign"][order])
            size = np.diff(np.concatenate([first, [len(r)]]))
            heavy = np.empty(len(r), bool)
            heavy[order] = np.repeat(size >= HEAVY, size)
            send = ~heavy
            send[order[first]] = True
            if heavy.any():
                yield dealt(r[heavy], (r["cls"][heavy].view(H.U) % H.U(parts)).astype(np.int64), True)
            yield dealt(r[send], (r["sign"][send] % H.U(parts)).astype(np.int64), False)

        for _, texts in text_slices(batches, SLICE):
            for s in shingle_sets(texts, how.shingle):
                if len(s) and (c := class_of(s)) not in seen:
                    seen.add(c)
                    own = np.unique(signs(s, common, how))
                    r = np.empty(len(own), SIGN)
                    r["sign"], r["cls"] = own, c
                    held.append(r)
            if sum(map(len, held)) >= FLUSH:
                yield from flush()
        if held:
            yield from flush()

    return run


def unblobbed(blobs: list[bytes]) -> np.ndarray:
    counts = [len(x) // SIGN.itemsize for x in blobs]
    r, at = np.empty(sum(counts), SIGN), 0
    for blob, n in zip(blobs, counts, strict=True):
        offset = 0
        for f in SIGN.names:
            r[f][at : at + n] = np.frombuffer(blob, SIGN[f], n, offset)
            offset += n * SIGN[f].itemsize
        at += n
    return r


def shared_rows(r: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(sign, cls, size), size being the number of classes that have the sign here."""
    r = r[np.lexsort((r["cls"], r["sign"]))]
    size = np.diff(np.concatenate([H.group_starts(r["sign"]), [len(r)]])) if len(r) else np.empty(0, np.int64)
    size = np.repeat(size, size)
    for a in range(0, len(r), 100_000):
        x = r[a : a + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(x["sign"].view(np.int64)), pa.array(np.ascontiguousarray(x["cls"])), pa.array(size[a : a + 100_000])], names=["sign", "cls", "size"])


def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The signs that several classes of a partition share, and those that are known to be."""
    blobs = []
    for b in batches:
        for known, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if known:
                yield from shared_rows(unblobbed([blob]))
            else:
                blobs.append(blob)
    r = unblobbed(blobs)
    del blobs
    order = np.argsort(r["sign"], kind="stable")
    s = r["sign"][order]
    several = np.zeros(len(s), bool)
    same = s[1:] == s[:-1]
    several[1:] |= same
    several[:-1] |= same
    r = r[order[several]]
    r = r[np.lexsort((r["cls"], r["sign"]))]
    if len(r):
        r = r[np.concatenate([[True], (r["sign"][1:] != r["sign"][:-1]) | (r["cls"][1:] != r["cls"][:-1])])]
        size = np.diff(np.concatenate([H.group_starts(r["sign"]), [len(r)]]))
        yield from shared_rows(r[np.repeat(size > 1, size)])


def parity(s: np.ndarray) -> bytes:
    """The parity sketch of a set, of 4 to 8 bits an element, 64 at least."""
    bits = max(64, 4 << len(s).bit_length())
    odd = np.bincount((s & H.U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """The Hamming distance of two sketches; the longer one is folded to the other's length, which keeps parities."""
    if len(x) < len(y):
        x, y = y, x
    a, bits = int.from_bytes(x, "big"), 8 * len(x)
    while bits > 8 * len(y):
        bits //= 2
        a = a >> bits ^ a & (1 << bits) - 1
    return (a ^ int.from_bytes(y, "big")).bit_count()


#: Payloads and pairs that meet in one partition: with sketches, with whole sets.
SKETCH_PAIRS, SET_PAIRS = 20_000, 2_000
#: From so many partners on, a class's pairs are dealt to several partitions.
MANY = 256
#: A block of a family: classes and shingles.
BLOCK, BLOCK_SHINGLES = 512, 2_000_000
#: At most one in so many classes counts as hot.
HOT_SHARE = 1000


def by_pair(decide: Callable) -> Callable:
    """A partition of payloads (cls, n, payload) and of pairs of their classes: the pairs that decide() takes."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        have = {c: (n, x) for c, n, x in zip(*(left.column(k).to_pylist() for k in ("cls", "n", "payload")), strict=True)}
        taken = [(a, b) for a, b in zip(right.column("a").to_pylist(), right.column("b").to_pylist(), strict=True) if a in have and b in have and decide(*have[a], *have[b])]
        return pa.table([pa.array([a for a, _ in taken], pa.int64()), pa.array([b for _, b in taken], pa.int64())], names=["a", "b"])

    return run


def meeting(pairs: DataFrame, payloads: DataFrame, decide: Callable, each: int) -> DataFrame:
    """Of distinct pairs (a, b) of classes, those that decide() takes. There are as many partitions as there are each pairs; a payload
    goes once to each partition that needs it, and the pairs of a class with many partners are dealt to several."""
    parts = pairs.count() // each + 1
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("partners")).where(F.col("partners") > MANY).select("a", (F.col("partners") / MANY + 1).cast("long").alias("spread"))
    dealt = pairs.join(many, "a", "left").withColumn("share", F.pmod(F.xxhash64("b"), F.coalesce("spread", F.lit(1))))
    placed = dealt.select("a", "b", F.pmod(F.xxhash64("a", "share"), F.lit(parts)).cast("int").alias("part"))
    wanted = placed.select(F.col("part").alias("home"), F.explode(F.array("a", "b")).alias("cls")).distinct()
    sent = wanted.join(payloads, "cls").select("home", "cls", "n", "payload")
    return sent.groupBy("home").cogroup(placed.groupBy("part")).applyInArrow(by_pair(decide), "a long, b long")


def elements(how: Similarity) -> Callable:
    """(cls, text) to (cls, n, payload): the sorted set of each class, of texts that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for classes, texts in text_slices(batches, SLICE):
            found = [(c, s) for c, s in zip(classes, shingle_sets(texts, how.shingle), strict=True) if len(s) and class_of(s) == c]  # a doc_id may have several texts
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([len(s) for _, s in found], pa.int64()), pa.array([s.tobytes() for _, s in found], pa.binary())], names=["cls", "n", "payload"])

    return run


def identifier() -> Column:
    """What a row is looked up by: its doc_id, or a digest of its text."""
    return F.coalesce("doc_id", F.xxhash64("text"))


def sets_of(classes: DataFrame, rows: DataFrame, how: Similarity) -> DataFrame:
    """(cls, n, payload) of classes (cls, id): the sets of one row each."""
    wanted = saved(classes, "wanted")
    found = rows.withColumn("id", identifier()).join(few(wanted), "id").select("cls", "text")
    return saved(found.mapInArrow(elements(how), "cls long, n long, payload binary").dropDuplicates(["cls"]), "sets")


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of batches in order of their first columns, by those."""
    at, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:keys] != at:
                if held:
                    yield at, held
                at, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield at, held


MEMBERS = "family long, block long, cls long, comp long, n long, payload binary"
PACKED = "family long, block long, one long, blob binary"


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """MEMBERS in order of family and block, as a blob for each block; one: the component of all of its classes, if it is one."""
    for (family, block), rows in groups(batches, 2):
        cls, comp, n, payload = zip(*rows, strict=True)
        blob = b"".join([len(rows).to_bytes(8, "little"), np.array([cls, comp, n], np.int64).tobytes(), np.array([len(p) for p in payload], np.int64).tobytes(), *payload])
        yield pa.RecordBatch.from_arrays([pa.array([family], pa.int64()), pa.array([block], pa.int64()), pa.array([comp[0] if len(set(comp)) == 1 else None], pa.int64()), pa.array([blob], pa.binary())], names=["family", "block", "one", "blob"])


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Classes, components, sizes and sketches of a block."""
    rows = int.from_bytes(blob[:8], "little")
    cls, comp, n, length = np.frombuffer(blob, np.int64, 4 * rows, 8).reshape(4, rows)
    ends = (8 + 32 * rows + np.cumsum(length)).tolist()
    return cls, comp, n, [blob[e - k : e] for e, k in zip(ends, length.tolist(), strict=True)]


def folded(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches as rows of size / 8 words; one of twice that size is folded, which keeps parities."""
    out = np.zeros((len(sketches), size // 8), np.uint64)
    for i, s in enumerate(sketches):
        words = np.frombuffer(s, np.uint64).reshape(-1, size // 8)
        out[i] = np.bitwise_xor.reduce(words, axis=0)
    return out


def near(x: tuple, y: tuple, same: bool, how: Similarity) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of classes of two blocks, of different components, whose sizes and sketches allow a link."""
    (_, compx, nx, sx), (_, compy, ny, sy) = x, y
    sizex, sizey = (np.array([len(s) for s in sketches], np.int64) for sketches in (sx, sy))
    for size in np.unique(np.concatenate([sizex, sizey])).tolist():
        # by the smaller size of the two: both have it, or one has twice that
        for other in ((size, size), (size, 2 * size), (2 * size, size)):
            i, j = np.flatnonzero(sizex == other[0]), np.flatnonzero(sizey == other[1])
            if not len(i) or not len(j):
                continue
            i, j = i[np.argsort(nx[i], kind="stable")], j[np.argsort(ny[j], kind="stable")]
            a, b, nj = folded([sx[k] for k in i.tolist()], size), folded([sy[k] for k in j.tolist()], size), ny[j]
            step = max(1, 2_000_000 // max(1, len(j) * (size // 8)))
            for at in range(0, len(i), step):
                ni = nx[i[at : at + step]]
                lo, hi = np.searchsorted(nj, ni[0] * how.num // how.den), np.searchsorted(nj, -(-ni[-1] * how.den // how.num), side="right")
                if lo == hi:
                    continue
                d = np.bitwise_count(a[at : at + step, None, :] ^ b[None, lo:hi, :]).sum(axis=2, dtype=np.int64)
                total = ni[:, None] + nj[None, lo:hi]
                fits = np.minimum(ni[:, None], nj[None, lo:hi]) * how.den >= np.maximum(ni[:, None], nj[None, lo:hi]) * how.num
                fits &= (d * (how.den + how.num) <= (how.den - how.num) * total) & (compx[i[at : at + step]][:, None] != compy[j[lo:hi]][None, :])
                p, q = np.nonzero(fits)
                p, q = i[at + p], j[lo + q]
                if same:
                    p, q = p[p < q], q[p < q]
                if len(p):
                    yield p, q


def warm(how: Similarity) -> Callable:
    """Pairs of packed blocks (family, block, other, blob, its blob) to the classes of each that have a possible partner in the other component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for family, i, j, first, second in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = unpack(first)
                y = x if i == j else unpack(second)
                hitx, hity = np.zeros(len(x[0]), bool), np.zeros(len(y[0]), bool)
                for p, q in near(x, y, i == j, how):
                    hitx[p], hity[q] = True, True
                if i == j:
                    hitx |= hity
                    hity[:] = False
                cls, comp = np.concatenate([x[0][hitx], y[0][hity]]), np.concatenate([x[1][hitx], y[1][hity]])
                if len(cls):
                    cls, at = np.unique(cls, return_index=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cls), v, np.int64)) for v in (family, i, j)] + [pa.array(cls), pa.array(comp[at])], names=["family", "block", "other", "cls", "comp"])

    return run


def spanning(how: Similarity) -> Callable:
    """Rows (family, block, other, cls, comp, n, payload), in order of the first three, with whole sets: links enough to join all that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches, 3):
            sets = [np.frombuffer(r[3], np.uint64) for r in rows]
            block = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), [parity(s) for s in sets]
            parent = {c: c for c in block[1].tolist()}

            def root(c: int, parent: dict = parent) -> int:
                while parent[c] != c:
                    parent[c] = c = parent[parent[c]]
                return c

            found = []
            for p, q in near(block, block, True, how):
                for i, j in zip(p.tolist(), q.tolist(), strict=True):
                    u, v = root(rows[i][1]), root(rows[j][1])
                    if u != v and how.linked(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), len(sets[i]), len(sets[j])):
                        parent[max(u, v)] = min(u, v)
                        found.append((rows[i][0], rows[j][0]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return run


def families_of(shared: DataFrame) -> DataFrame:
    """(family, cls, rank): a family is named by the highest rank of the classes that share a part, which are its members; the class of
    that rank is its head. A rank has a degree above, so that a class which meets many others is a head rather than they."""
    degree = F.least(F.lit(255), F.floor(4 * F.log2(F.col("degree") + 1))).cast("long")
    ranks = shared.groupBy("cls").agg(F.sum("size").alias("degree")).select("cls", F.shiftleft(degree, 55).bitwiseOR(F.shiftrightunsigned("cls", 9)).alias("rank"))
    ranked = saved(shared.join(ranks, "cls").select("sign", "cls", "rank"), "ranked")
    tops = ranked.groupBy("sign").agg(F.max("rank").alias("family"))
    return saved(ranked.join(tops, "sign").select("family", "cls", "rank").distinct(), "families")


def across(families: DataFrame, comp: DataFrame, sketches: DataFrame, how: Similarity) -> DataFrame:
    """(family, block, other, cls, comp): the classes of families with several components that may link across these, by pairs of blocks.

    A component with more members than a block has blocks of its own, which are not compared with each other."""
    sized = families.join(comp.withColumnRenamed("node", "cls"), "cls", "left").select("family", "cls", F.coalesce("comp", "cls").alias("comp"))
    labelled = saved(sized.join(sketches.select("cls", "n"), "cls").select("family", "cls", "comp", "n"), "labelled")
    open_ = labelled.groupBy("family").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("shingles"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi")
    blocks = F.greatest(F.ceil(F.col("classes") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).alias("blocks")
    large = labelled.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("own")).where(F.col("own") > BLOCK)
    mixed, alone = F.pmod(F.xxhash64("comp"), "blocks"), F.shiftrightunsigned(F.xxhash64("comp", F.pmod(F.xxhash64("cls"), F.ceil(F.col("own") / BLOCK))), 1)
    dealt = labelled.join(open_.select("family", blocks), "family").join(large, ["family", "comp"], "left").select("family", F.when(F.col("own").isNull(), mixed).otherwise(alone).alias("block"), "cls", "comp", "n")
    members = dealt.join(sketches.select("cls", "payload"), "cls").select("family", "block", "cls", "comp", "n", "payload")
    packed = saved(members.repartition("family", "block").sortWithinPartitions("family", "block").mapInArrow(pack, PACKED), "blocks")
    other = packed.select("family", F.col("block").alias("other"), F.col("one").alias("its_one"), F.col("blob").alias("its_blob"))
    met = packed.join(other, "family").where((F.col("block") <= F.col("other")) & ~F.coalesce(F.col("one") == F.col("its_one"), F.lit(False)))
    blob = F.when(F.col("block") != F.col("other"), F.col("its_blob"))
    return saved(met.select("family", "block", "other", "blob", blob.alias("its_blob")).mapInArrow(warm(how), "family long, block long, other long, cls long, comp long"), "warm")


def near_duplicates(docs: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """A row for each document: doc_id, key (xxhash64 of the text), n_shingles, component_id, class_id, which equal sets share, and
    group_id, which all that link share; both are null without a set."""
    spark = docs.sparkSession
    rows, parts = id_and_text(docs), partitions(spark)
    surveyed = saved(rows.withColumn("key", F.xxhash64("text")).mapInArrow(survey(how), SURVEY), "classes")
    counted = surveyed.where("chunk is not null").select("chunk", "counts")
    sums = counted.mapInArrow(add_counts, counted.schema).repartition(CHUNKS, "chunk").mapInArrow(add_counts, counted.schema)
    table = {r["chunk"]: bytes(r["counts"]) for r in sums.collect()}  # 4 MB at any size of the corpus
    size = (4 << COUNTERS_LOG2) // CHUNKS
    counters = spark.sparkContext.broadcast(b"".join(table.get(i, bytes(size)) for i in range(CHUNKS)))
    signed = rows.mapInArrow(sketch(how, counters, parts), "part int, shared boolean, blob binary")
    shared = saved(signed.repartitionById(parts, F.col("part")).mapInArrow(share, "sign long, cls long, size long"), "shared")

    families = families_of(shared)
    needed = families.select("cls").distinct()
    first = surveyed.where("cls is not null").groupBy("cls").agg(F.min(F.coalesce("doc_id", "key")).alias("id"))
    known = surveyed.where("sketch is not null").select("cls", "n", F.col("sketch").alias("payload"))
    sketches = saved(known.join(needed, "cls").dropDuplicates(["cls"]), "sketches")

    def maybe(n: int, x: bytes, m: int, y: bytes) -> bool:
        return min(n, m) * how.den >= max(n, m) * how.num and apart(x, y) * (how.den + how.num) <= (how.den - how.num) * (n + m)

    def surely(n: int, x: bytes, m: int, y: bytes) -> bool:
        return how.linked(len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)), n, m)

    heads = families.where("rank = family").select("family", F.col("cls").alias("a"))
    star = saved(families.join(heads, "family").where("cls != a").select("a", F.col("cls").alias("b")).distinct(), "pairs")
    likely = saved(meeting(star, sketches, maybe, SKETCH_PAIRS), "near")
    ends = likely.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    links = saved(meeting(likely, sets_of(ends.join(first, "cls"), rows, how), surely, SET_PAIRS), "links")
    comp = components(links)
    candidates = across(families.select("family", "cls"), comp, sketches, how)
    if not candidates.isEmpty():
        sets = sets_of(candidates.select("cls").distinct().join(first, "cls"), rows, how)
        keys = ["family", "block", "other"]
        met = candidates.join(sets, "cls").select(*keys, "cls", "comp", "n", "payload").repartition(*keys).sortWithinPartitions(*keys)
        more = saved(met.mapInArrow(spanning(how), "a long, b long"), "links")
        comp = components(links.unionByName(more))
    return named(surveyed.where("chunk is null").select("doc_id", "key", "n", "cls"), comp)


def named(members: DataFrame, comp: DataFrame) -> DataFrame:
    """Of (doc_id, key, n, cls) with the components of classes (node, comp), each document with the least doc_id that it reaches.

    Classes of one document without links keep it; those of a thousandth of all documents and more, which can be a thousand at most,
    are sent to all tasks, so that no task gets all documents of one."""
    classes = saved(members.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("docs")).join(comp.withColumnRenamed("node", "cls"), "cls", "left"), "members")
    linked = classes.where("comp is not null").groupBy("comp").agg(F.min("least").alias("of_all"))
    several = classes.where("comp is not null or docs > 1").join(linked, "comp", "left").select("cls", "docs", F.coalesce("of_all", "least").alias("component"), "comp")
    several = saved(several, "components")
    total = classes.agg(F.sum("docs")).first()[0] or 0
    hot = several.where(F.col("docs") > max(1000, total // HOT_SHARE)).select("cls", "component", "comp")
    out = ["doc_id", "key", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.col("cls").alias("class_id"), F.coalesce("comp", "cls").alias("group_id")]
    full = members.where("cls is not null")
    often = full.join(F.broadcast(hot), "cls").select(*out)
    seldom = full.join(F.broadcast(hot.select("cls")), "cls", "left_anti").join(several.select("cls", "component", "comp"), "cls", "left").select(*out)
    empty = members.where("cls is null").withColumns({"component": F.col("doc_id"), "comp": F.lit(None).cast("long")}).select(*out)
    return often.unionByName(seldom).unionByName(empty)
