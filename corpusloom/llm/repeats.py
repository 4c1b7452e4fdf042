"""Places of windows of a fixed length that occur more than once in a corpus: what the two substring operators share.

A window is routed by its minimizer, the k-gram of least hash inside it: equal windows have equal minimizers. Consecutive windows with
the same minimizer make a stretch, and a stretch travels as digests only: minimizer, content, document, place and length.

1. A task finds the stretches of its texts. Of those with equal content it sends the first, with their count; the others are settled.
2. Where a minimizer's stretches meet, a stretch whose content has come before is settled as a whole. A minimizer with several
   contents may hold windows that these have in common: one place of each content is asked for.
3. The documents give the symbols asked for; where they meet, the operator's own method compares their windows (find).
4. Settled and found ranges go to their documents and are cut out.

A minimizer with many contents is hot, and no task gets all of them: its stretches meet by content, and what is asked of their documents
is a digest of each window instead of symbols, which meet by digest, combined in each task before.

A document is a doc_id and a digest of its text: rows that repeat both are one document, rows with one doc_id and unlike texts are
several. A place is a document and a start; documents are in order of doc_id, then of digest. Every exchange carries blobs of packed
arrays, or texts, to an explicit partition; there are as many partitions as the bytes of all texts ask for. Texts are streamed past the
blobs of their partition, which come before them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import hashing as H
from .base import id_and_text, partitions, saved, slices_of, text_slices

NULL_ID = -(1 << 63)
SLICE = 1_000_000
FLUSH = 300_000
#: Bytes of text for each partition, at most.
PART_BYTES = 128 << 20
#: So many identifiers are sent to all tasks at most.
SENT = 1_000_000
#: A minimizer is hot from so many contents in one batch of a task, or where it meets.
HEAVY, HOT = 64, 5000
STRETCH = np.dtype([("m", "u8"), ("c", "u8"), ("doc", "i8"), ("key", "i8"), ("start", "u4"), ("length", "u2"), ("count", "u1"), ("hot", "u1")])
RANGE = np.dtype([("doc", "i8"), ("key", "i8"), ("start", "u4"), ("length", "u2")])
ASK = np.dtype([("m", "u8"), ("doc", "i8"), ("key", "i8"), ("start", "u4"), ("length", "u2"), ("count", "u1"), ("hot", "u1")])
RANGES, STRETCHES, HEAVIES, ASKED = 0, 1, 2, 3
BLOB = "kind int, part int, blob binary"
_BLOB = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("blob", pa.binary())])


@dataclass(frozen=True)
class Windows:
    """What is compared: windows of size symbols; grams of so many symbols are candidates for minimizers."""

    size: int
    gram: int
    by_words: bool


def symbols(texts: list[bytes], by_words: bool) -> tuple[np.ndarray, np.ndarray]:
    if by_words:
        return H.words(texts)[:2]
    data, bounds = H.byte_array(texts)
    return H.BYTE_SYMBOLS[data], bounds


def stretches(ids: list[int], keys: list[int], texts: list[bytes], w: Windows) -> np.ndarray:
    """The stretches of some texts, in order."""
    values, bounds = symbols(texts, w.by_words)
    n = len(values)
    if n < w.size:
        return np.empty(0, STRETCH)
    sums = H.prefix(values)
    grams = H.all_windows(sums, w.gram)
    bits = int(n).bit_length()  # a place, below the gram's hash: of equal grams the first counts
    least = (grams & ~H.U((1 << bits) - 1)) | np.arange(len(grams), dtype=H.U)
    width, have = w.size - w.gram + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    at = (least & H.U((1 << bits) - 1)).astype(np.int64)
    inside = np.zeros(n + 1, np.int8)
    start, last = bounds[:-1], np.maximum(bounds[:-1], bounds[1:] - w.size + 1)
    np.add.at(inside, start, 1)
    np.add.at(inside, last, -1)
    valid = np.cumsum(inside[:-1], dtype=np.int8)[: len(at)] > 0
    edge = np.empty(len(at), bool)
    edge[0] = True
    edge[1:] = (at[1:] != at[:-1]) | ~valid[:-1]
    edge &= valid
    starts = np.flatnonzero(edge)
    stop = np.zeros(len(at), bool)
    stop[:-1] = edge[1:] | ~valid[1:]
    stop[-1] = True
    ends = np.flatnonzero(stop & valid) + w.size
    doc = np.searchsorted(bounds, starts, side="right") - 1
    out = np.empty(len(starts), STRETCH)
    out["m"] = grams[at[starts]]
    out["c"] = H.windows(sums, starts, ends)
    out["doc"], out["key"] = np.array(ids, np.int64)[doc], np.array(keys, np.int64)[doc]
    out["start"], out["length"], out["count"], out["hot"] = starts - bounds[doc], ends - starts, 1, 0
    return out


def distinct(records: np.ndarray) -> np.ndarray:
    """Stretches by content, document and start; a place counts once, however many rows have it."""
    r = records[np.lexsort((records["start"], records["key"], records["doc"], records["c"]))]
    if len(r):
        same = np.ones(len(r) - 1, bool)
        for f in ("c", "doc", "key", "start"):
            same &= r[f][1:] == r[f][:-1]
        r = r[np.concatenate([[True], ~same])]
    return r


def combined(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first stretch of each content, with its count (2 for more), and those after it."""
    order = np.argsort(records["c"], kind="stable")
    c = records["c"][order]
    several = np.zeros(len(c), bool)
    same = c[1:] == c[:-1]
    several[1:] |= same
    several[:-1] |= same
    alone, many = records[order[~several]], distinct(records[order[several]])
    first = H.group_starts(many["c"])
    counts = np.minimum(2, np.add.reduceat(many["count"].astype(np.int64), first)) if len(many) else first
    rest = np.ones(len(many), bool)
    rest[first] = False
    heads = many[first].copy()
    heads["count"] = counts
    if len(many):
        heads["hot"] = np.maximum.reduceat(many["hot"], first)
    return np.concatenate([alone, heads]), many[rest]


def ranges_of(records: np.ndarray) -> np.ndarray:
    out = np.empty(len(records), RANGE)
    for f in RANGE.names:
        out[f] = records[f]
    return out


def doc_part(records: np.ndarray, parts: int) -> np.ndarray:
    """The partition of each document; in SQL: home()."""
    docs = records["doc"]
    return (records["key"] ^ docs ^ (docs >> 7) ^ (docs >> 21)) % parts


def home(parts: int) -> Column:
    doc = F.coalesce(F.col("doc_id"), F.lit(NULL_ID))
    return F.pmod(F.col("key").bitwiseXOR(doc).bitwiseXOR(F.shiftright(doc, 7)).bitwiseXOR(F.shiftright(doc, 21)), F.lit(parts)).cast("int")


def dealt(kind: int, records: np.ndarray, part: np.ndarray) -> Iterator[tuple]:
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    records, part = records[order], part[order]
    first = H.group_starts(part)
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(part)], strict=True):
        yield kind, int(part[a]), columns(records[a:b])


def columns(records: np.ndarray) -> bytes:
    """Packed field by field, which compresses better."""
    return b"".join(np.ascontiguousarray(records[f]).tobytes() for f in records.dtype.names)


def unpacked(blobs: list[bytes], kind: np.dtype) -> np.ndarray:
    counts = [len(b) // kind.itemsize for b in blobs]
    out, at = np.empty(sum(counts), kind), 0
    for blob, n in zip(blobs, counts, strict=True):
        offset = 0
        for f in kind.names:
            size = kind[f].itemsize * n
            out[f][at : at + n] = np.frombuffer(blob, kind[f], n, offset)
            offset += size
        at += n
    return out


def batch(rows: list[tuple], schema: pa.Schema = _BLOB) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def by_minimizer(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The records in order of minimizers, and how many each one's minimizer has."""
    records = records[np.argsort(records["m"], kind="stable")]
    first = H.group_starts(records["m"])
    size = np.diff(np.concatenate([first, [len(records)]]))
    return records, np.repeat(size, size)


def map_stretches(w: Windows, parts: int, heavy: int = HEAVY) -> Callable:
    """The stretches of a task, to the partition of their minimizer. A hot one's go to the partitions of their contents, and one of them,
    so marked, to that of the minimizer, where it may meet those of tasks in which it is not hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            send, settled = combined(np.concatenate(held))
            held.clear()
            send, size = by_minimizer(send)
            often = size >= heavy
            rows = list(dealt(RANGES, ranges_of(settled), doc_part(settled, parts)))
            if often.any():
                hot = send[often]
                hot["hot"] = 1
                rows += dealt(HEAVIES, hot, (hot["c"] % H.U(parts)).astype(np.int64))
                send = np.concatenate([send[~often], hot[H.group_starts(hot["m"])]])
            rows += dealt(STRETCHES, send, (send["m"] % H.U(parts)).astype(np.int64))
            if rows:
                yield batch(rows)

        for ids, texts, keys in text_slices(batches, SLICE, True):
            held.append(stretches([NULL_ID if k is None else k for k in ids], keys, [t.encode() for t in texts], w))
            if sum(map(len, held)) >= FLUSH:
                yield from flush()
        if held:
            yield from flush()

    return run


def meet(first_stays: bool, parts: int, hot: int = HOT) -> Callable:
    """A partition of stretches: ranges that are settled, and places whose symbols must be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {STRETCHES: [], HEAVIES: []}
        for b in batches:
            for kind, part, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == RANGES:
                    yield batch([(kind, part, blob)])
                else:
                    blobs[kind].append(blob)
        asked = []
        for kind, held in blobs.items():
            r = unpacked(held, STRETCH)
            held.clear()
            if not len(r):
                continue
            if kind == STRETCHES:
                r, size = by_minimizer(r)
                r = r[(size > 1) | (r["count"] > 1) | (r["hot"] > 0)]
            heads, rest = combined(r)
            settled = rest if first_stays else np.concatenate([rest, heads[heads["count"] > 1]])
            if kind == STRETCHES:
                heads, size = by_minimizer(heads)
                first = H.group_starts(heads["m"])
                if len(heads):
                    heads["hot"] = np.repeat(np.maximum.reduceat(heads["hot"], first) | (size[first] > hot), size[first])
                heads = heads[(size > 1) | (heads["hot"] > 0)]
            ask = np.empty(len(heads), ASK)
            for f in ASK.names:
                ask[f] = heads[f]
            asked.append(ask)
            rows = list(dealt(RANGES, ranges_of(settled), doc_part(settled, parts)))
            if rows:
                yield batch(rows)
        if asked:
            asked = np.concatenate(asked)
            rows = list(dealt(ASKED, asked, doc_part(asked, parts)))
            if rows:
                yield batch(rows)

    return run


def beside(blobs: DataFrame, rows: DataFrame, parts: int) -> DataFrame:
    """Blobs and texts (doc_id, text, key, ...) of each partition, the blobs first: (part, late, blob, doc_id, text, key, ...)."""
    early = blobs.select("part", F.lit(False).alias("late"), "blob", *[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])
    late = rows.select(home(parts).alias("part"), F.lit(True).alias("late"), F.lit(None).cast("binary").alias("blob"), *rows.columns)
    return early.unionByName(late).repartitionById(parts, F.col("part")).sortWithinPartitions("late")


def streamed(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[tuple[np.ndarray, list, list, list, pa.RecordBatch]]:
    """From a partition of beside(): its records, in order of documents, with each slice of ids, texts and keys, and as a batch."""
    blobs: list[bytes] = []
    records = None
    for b in batches:
        early = b.num_rows - int(np.count_nonzero(b.column(1).to_numpy(zero_copy_only=False)))
        blobs += b.column(2).slice(0, early).to_pylist()
        if early == b.num_rows:
            continue
        if records is None:
            records = unpacked(blobs, kind)
            records = records[np.lexsort((records["start"], records["key"], records["doc"]))]
            blobs.clear()
        for x in slices_of(b.slice(early), 4, SLICE):
            yield records, x.column(3).to_pylist(), x.column(4).to_pylist(), x.column(5).to_pylist(), x


def bounds_of(records: np.ndarray, ids: list, keys: list) -> list[tuple[int, int]]:
    """Where the records of each of some documents are."""
    out = []
    doc, key = records["doc"], records["key"]
    docs = np.array([NULL_ID if i is None else i for i in ids], np.int64)
    for d, k, lo, hi in zip(docs.tolist(), keys, np.searchsorted(doc, docs).tolist(), np.searchsorted(doc, docs, side="right").tolist(), strict=True):
        if hi > lo and (key[lo] != k or key[hi - 1] != k):  # several texts may have one doc_id
            a, b = np.searchsorted(key[lo:hi], k), np.searchsorted(key[lo:hi], k, side="right")
            lo, hi = lo + int(a), lo + int(b)
        out.append((lo, hi))
    return out


def give(w: Windows, parts: int) -> Callable:
    """A partition of asked places and documents: the symbols there, to the partition of the minimizer; of hot ones, digests of windows."""
    kind = np.dtype("u8") if w.by_words else np.dtype("u1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, bodies, digests, size = [], [], [], 0
        done: set[int] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            rows = []
            if heads:
                head, body = np.concatenate(heads), np.concatenate(bodies)
                part = (head["m"] % H.U(parts)).astype(np.int64)
                at = np.concatenate([[0], np.cumsum(head["length"], dtype=np.int64)])
                order = np.argsort(part, kind="stable")
                first = H.group_starts(part[order])
                for a, b in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
                    mine = order[a:b]
                    data = b"".join(body[at[i] : at[i + 1]].astype(kind).tobytes() for i in mine.tolist())
                    rows.append((ASKED, int(part[mine[0]]), len(mine).to_bytes(8, "little") + columns(head[mine]) + data))
            if digests:
                found = np.concatenate(digests)
                send, settled = combined(found)
                rows += dealt(STRETCHES, send, (send["m"] % H.U(parts)).astype(np.int64))
                rows += dealt(RANGES, ranges_of(settled), doc_part(settled, parts))
            heads.clear(), bodies.clear(), digests.clear()
            size = 0
            if rows:
                yield batch(rows)

        for asked, ids, texts, keys, _ in streamed(batches, ASK):
            for text, (lo, hi) in zip(texts, bounds_of(asked, ids, keys), strict=True):
                if lo == hi or lo in done:  # rows that repeat a document
                    continue
                done.add(lo)
                mine = once(asked[lo:hi])
                raw = text.encode()
                values = H.words([raw])[0] if w.by_words else np.frombuffer(raw, np.uint8)
                hot = mine["hot"] > 0
                if hot.any():
                    sums = H.prefix(values if w.by_words else H.BYTE_SYMBOLS[values])
                    digests.append(window_records(mine[hot], sums, w.size))
                    size += w.size * len(digests[-1])
                    mine = mine[~hot]
                if len(mine):
                    length = mine["length"].astype(np.int64)
                    take = np.repeat(mine["start"] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
                    heads.append(mine)
                    bodies.append(values[take])
                    size += len(take)
                if size >= 4_000_000:
                    yield from flush()
        yield from flush()

    return run


def once(asked: np.ndarray) -> np.ndarray:
    """Each place of a document once, in order of starts: with its higher count, and as hot where it is."""
    same = asked["start"][1:] == asked["start"][:-1]
    if not same.any():
        return asked
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    out = asked[first].copy()
    out["count"], out["hot"] = np.maximum.reduceat(asked["count"], first), np.maximum.reduceat(asked["hot"], first)
    return out


def window_records(places: np.ndarray, sums: np.ndarray, size: int) -> np.ndarray:
    """Each window of some places as a stretch of its own, its digest being minimizer and content."""
    n = places["length"].astype(np.int64) - size + 1
    of = np.repeat(np.arange(len(places)), n)
    start = places["start"].astype(np.int64)[of] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out = np.empty(len(of), STRETCH)
    out["m"] = out["c"] = H.windows(sums, start, start + size)
    for f in ("doc", "key", "count"):
        out[f] = places[f][of]
    out["start"], out["length"], out["hot"] = start, size, 0
    return out


def compare(w: Windows, find: Callable, first_stays: bool, parts: int) -> Callable:
    """A partition of places with their symbols, to ranges of windows that find names; and of windows by digest."""
    kind = np.dtype("u8") if w.by_words else np.dtype("u1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, bodies, digests = [], [], []
        for b in batches:
            for what, part, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if what == RANGES:
                    yield batch([(what, part, blob)])
                elif what == STRETCHES:
                    digests.append(blob)
                else:
                    n = int.from_bytes(blob[:8], "little")
                    heads.append(unpacked([blob[8 : 8 + n * ASK.itemsize]], ASK))
                    bodies.append(np.frombuffer(blob, kind, offset=8 + n * ASK.itemsize))
        if digests:
            first, rest = combined(unpacked(digests, STRETCH))
            settled = rest if first_stays else np.concatenate([rest, first[first["count"] > 1]])
            rows = list(dealt(RANGES, ranges_of(settled), doc_part(settled, parts)))
            if rows:
                yield batch(rows)
        if not heads:
            return
        head, body = np.concatenate(heads), np.concatenate(bodies)
        at = np.concatenate([[0], np.cumsum(head["length"], dtype=np.int64)])
        order = np.argsort(head["m"], kind="stable")
        first = H.group_starts(head["m"][order])
        ends = [*first[1:].tolist(), len(order)]
        pending: list[int] = []
        for k, (a, b) in enumerate(zip(first.tolist(), ends, strict=True)):  # whole minimizers, some 800,000 symbols at once
            pending += order[a:b].tolist()
            if k == len(ends) - 1 or len(pending) * w.size > 500_000:
                mine = np.array(pending)
                pending = []
                length = head["length"][mine].astype(np.int64)
                take = np.repeat(at[mine] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
                place, start = find(body[take], head[mine], w.size)
                if len(place):
                    found = runs(head[mine], place, start, w.size)
                    yield batch(list(dealt(RANGES, found, doc_part(found, parts))))

    return run


def runs(head: np.ndarray, place: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Windows by places and starts in the document, as ranges that they cover, in each place."""
    order = np.lexsort((start, place))
    place, start = place[order], start[order]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] - start[:-1] > size)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(place)]]) - 1
    out = np.empty(len(first), RANGE)
    out["doc"], out["key"] = head["doc"][place[first]], head["key"][place[first]]
    out["start"], out["length"] = start[first], start[last] + size - start[first]
    return out


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
#: What a cut gives, before the columns that are carried along.
CUT = "doc_id long, key long, n_units long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
_CUT = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), SPANS, pa.binary()]


def cut(w: Windows) -> Callable:
    """A partition of ranges to remove and documents: what is left of each, and the removed spans."""

    def without(raw: bytes, mine: np.ndarray) -> tuple:
        words = raw.split() if w.by_words else None  # of bytes: at [\x20\x09-\x0D]
        n = len(raw if words is None else words)
        if not len(mine):
            return n, 0, [], raw if words is None else b" ".join(words)
        mark = np.zeros(n + 1, np.int32)
        start = np.minimum(n, mine["start"].astype(np.int64))
        np.add.at(mark, start, 1)
        np.add.at(mark, np.minimum(n, start + mine["length"]), -1)
        gone = np.concatenate([[False], np.cumsum(mark[:-1]) > 0, [False]])
        edges = np.flatnonzero(gone[1:] != gone[:-1])
        gone = gone[1:-1]
        if words is not None:
            kept = b" ".join(compress(words, (~gone).tolist()))
        else:
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        return n, int(gone.sum()), [{"start": s, "end": e} for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)], kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ranges, ids, texts, keys, whole in streamed(batches, RANGE):
            done = [without(text.encode(), ranges[lo:hi]) for text, (lo, hi) in zip(texts, bounds_of(ranges, ids, keys), strict=True)]
            columns = [pa.array(c, t) for c, t in zip([ids, keys, *zip(*done, strict=True)], _CUT, strict=True)]
            more = [whole.column(4), whole.column(6)] if whole.num_columns > 6 else []
            yield pa.RecordBatch.from_arrays([*columns, *more], names=["doc_id", "key", "n_units", "n_removed", "spans", "kept", *["text", "carried"][: len(more)]])

    return run


def asked_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        asked = unpacked(b.column(0).to_pylist(), ASK)
        found = np.unique(np.stack([asked["doc"], asked["key"]], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["doc", "key"])


def removed(docs: DataFrame, w: Windows, first_stays: bool, find: Callable, heavy: int = HEAVY, hot: int = HOT, carry: bool = False) -> DataFrame:
    """Documents without the windows that occur elsewhere (first_stays: earlier), and the spans that went, in symbols; key: xxhash64 of the
    text. carry: with the text, and a struct carried of all other columns of docs.

    A stretch has fewer than twice a window's symbols, for which 16 bits must do."""
    if not 0 < w.gram <= w.size < 1 << 15:
        raise ValueError("windows of 1 to 32767 symbols, and grams that fit into them")
    spark = docs.sparkSession
    rows = id_and_text(docs).withColumn("key", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    parts = max(partitions(spark), size // PART_BYTES + 1)
    met = saved(rows.mapInArrow(map_stretches(w, parts, heavy), BLOB).repartitionById(parts, F.col("part")).mapInArrow(meet(first_stays, parts, hot), BLOB), "stretches")
    ranges, asked = met.where(F.col("kind") == RANGES), met.where(F.col("kind") == ASKED)
    wanted = saved(asked.select("blob").mapInArrow(asked_documents, "doc long, key long").distinct(), "asked")
    askable = rows
    if wanted.count() <= SENT:
        here = wanted.select("doc", F.col("key").alias("its_key"))
        askable = rows.join(F.broadcast(here), (F.coalesce("doc_id", F.lit(NULL_ID)) == F.col("doc")) & (F.col("key") == F.col("its_key")), "left_semi")
    given = beside(asked, askable, parts).mapInArrow(give(w, parts), BLOB)
    found = given.repartitionById(parts, F.col("part")).mapInArrow(compare(w, find, first_stays, parts), BLOB)
    whole = rows
    if carry:
        kinds = [f for f in docs.schema if f.name != "text"]
        text = F.coalesce("text", F.lit(""))
        whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"), F.struct(*[F.col("`" + f.name.replace("`", "``") + "`") for f in kinds]).alias("carried"))
    schema = StructType([*StructType.fromDDL(CUT), *[f for f in whole.schema if carry and f.name in ("text", "carried")]])
    return beside(ranges.unionByName(found), whole, parts).mapInArrow(cut(w), schema)
