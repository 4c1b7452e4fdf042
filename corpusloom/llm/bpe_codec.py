"""Byte-level BPE: overlapping chunks are pre-tokenised apart, stitched where their boundaries resynchronise, then encoded.

A pre-token starts where the one before ends and is decided by what follows alone, so that two chunks that share a boundary agree on
all that follows, up to the last pre-tokens that the end of a chunk may have changed. Every text goes this way, in chunks of a few
thousand characters; the chunks of texts beyond parallel_chars are dealt out to all tasks and stitched by document. Pieces are merged
one by one, through a cache of bounded size; decoding puts the bytes of all ids together.

The pattern must match at every place, and see no further than REACH characters beyond the end of what it matches.

Defined cases: null and empty text have no ids; special tokens' strings are ordinary text; an empty table gives no rows; repeated
rows give repeated results; a null doc_id stays null; a run without boundaries that is longer than the overlap is read on until
boundaries agree; other columns are ignored.
"""

from __future__ import annotations

import base64
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import id_and_text, text_slices

SCHEMA = "doc_id long, n_tokens long, ids binary, decoded binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])
#: A contraction is told from an apostrophe by two characters after it.
REACH = 3


class Codec:
    PIECES = 400_000

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.pattern = regex.compile(pattern)
        self.pieces: dict[str, bytes] = {}

    def pretokens(self, text: str, chunk: int, overlap: int) -> list[str]:
        """The pattern's matches in the whole text, from overlapping chunks."""
        starts = list(range(0, len(text), chunk))
        return stitch(text, starts, [self.pattern.findall(text, s, min(len(text), s + chunk + overlap)) for s in starts], self.pattern)

    def merged(self, pieces: list[str]) -> bytes:
        """The ids of pre-tokens, each merged by itself."""
        cache = self.pieces
        try:
            return b"".join(map(cache.__getitem__, pieces))
        except KeyError:
            if len(cache) >= self.PIECES:
                cache.clear()
            for p in [p for p in set(pieces) if p not in cache]:
                cache[p] = array("I", self.encoding._encode_single_piece(p.encode())).tobytes()
            return b"".join(map(cache.__getitem__, pieces))

    def encode(self, text: str, chunk: int = 2048, overlap: int = 128) -> bytes:
        return self.merged(self.pretokens(text, chunk, overlap))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(1)
def codec_of(ranks_path: str, pattern: str) -> Codec:
    """One for each worker process, so that its cache outlives a task."""
    return Codec(ranks_path, pattern)


def stitch(text: str, starts: list[int], chunks: list[list[str]], pattern) -> list[str]:
    """One list of pre-tokens from those of overlapping chunks at the given starts.

    The list so far is right up to the place at. A chunk goes on from its boundary there; if it has none, it started inside a pre-token
    and doesn't agree yet, and the text is matched on, piece by piece, until a boundary is one of the chunk's too. Pieces whose end is
    so near the chunk's that what follows might have changed them are left to the next chunk."""
    out: list[str] = []
    at = 0
    for k, pieces in enumerate(chunks):
        bounds = list(accumulate(map(len, pieces), initial=starts[k]))
        sure = len(pieces) if k == len(chunks) - 1 else bisect_right(bounds, bounds[-1] - REACH) - 1
        i = bisect_left(bounds, at)
        while i <= sure and bounds[i] != at:
            m = pattern.match(text, at)
            out.append(m[0])
            at = m.end()
            i = bisect_left(bounds, at, i)
        if i < sure:
            out += pieces[i:sure]
            at = bounds[sure]
    while at < len(text):
        m = pattern.match(text, at)
        out.append(m[0])
        at = m.end()
    return out


PARTS = "row long, doc_id long, k int, lengths binary, part string"


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = 2048, overlap: int = 128, parallel_chars: int = 65536) -> DataFrame:
    """A row for each document: its ids (little-endian unsigned 32-bit), their number, and the bytes that they decode to."""
    rows = id_and_text(docs)

    def result(codec: Codec, keys: list, ids: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(codec.decode, ids), pa.binary())], schema=_ARROW)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(ranks_path, pattern)
        for keys, texts in text_slices(batches):
            yield result(codec, keys, [codec.encode(t, chunk, overlap) for t in texts])

    def chop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A text's chunks, in one pass over it; the last ones of two texts never have one number."""
        context = TaskContext.get()
        row = (context.partitionId() if context else 0) << 33
        for keys, texts in text_slices(batches, parallel_chars):
            for key, text in zip(keys, texts, strict=True):
                for a in range(0, len(text), 16 * parallel_chars):
                    some = [text[s : s + parallel_chars + overlap] for s in range(a, min(len(text), a + 16 * parallel_chars), parallel_chars)]
                    n, first = len(some), a // parallel_chars
                    yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int64()), pa.array([key] * n, pa.int64()), pa.array(range(first, first + n), pa.int32()), pa.array(some)], names=["row", "doc_id", "k", "part"])
                row += 1

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The boundaries of each chunk, as lengths of its pre-tokens, beside it."""
        find = codec_of(ranks_path, pattern).pattern.findall
        for b in batches:
            for i in range(b.num_rows):
                x = b.slice(i, 1)
                lengths = np.array(list(map(len, find(x.column(3)[0].as_py()))), dtype="<u4").tobytes()
                yield pa.RecordBatch.from_arrays([*x.columns[:3], pa.array([lengths], pa.binary()), x.column(3)], names=["row", "doc_id", "k", "lengths", "part"])

    def join(table: pa.Table) -> pa.Table:
        """One long text: its chunks' boundaries stitched, then encoded."""
        table = table.sort_by("k")
        codec = codec_of(ranks_path, pattern)
        parts = table.column("part").to_pylist()
        text = "".join(p[:parallel_chars] for p in parts)
        chunks = []
        for p, lengths in zip(parts, table.column("lengths").to_pylist(), strict=True):
            ends = np.cumsum(np.frombuffer(lengths, "<u4"), dtype=np.int64).tolist()
            chunks.append([p[a:b] for a, b in zip([0, *ends], ends, strict=False)])
        pieces = stitch(text, list(range(0, len(text), parallel_chars)), chunks, codec.pattern)
        ids = b"".join(codec.merged(pieces[a : a + 100_000]) for a in range(0, len(pieces), 100_000))
        return pa.Table.from_batches([result(codec, table.column("doc_id")[:1].to_pylist(), [ids])])

    size = F.char_length("text")
    short = rows.where(size <= parallel_chars).mapInArrow(whole, SCHEMA)
    chunks = rows.where(size > parallel_chars).mapInArrow(chop, "row long, doc_id long, k int, part string").repartition("row", "k")
    cuts = chunks.mapInArrow(pretokenise, PARTS)
    return short.unionByName(cuts.groupBy("row").applyInArrow(join, SCHEMA))
