"""Arrow batches by the length of their texts or lists, since rows may be of any length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes or tokens that are worked at once.
SLICE = 1_000_000


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches in slices whose texts or lists, in a column by number, have most bytes or elements together, give or take one row."""
    for b in batches:
        x = b.column(column)
        lengths = pc.list_value_length(x) if pa.types.is_list(x.type) or pa.types.is_large_list(x.type) else pc.binary_length(x)
        ends = np.cumsum(np.array(pc.fill_null(lengths, 0), np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), b.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if end > start:
                yield b.slice(start, end - start)


def byte_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column, without a copy, and the bounds of its rows; a null row is empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    x = column.cast(pa.large_binary())
    offsets = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1]
    return np.frombuffer(x.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]
