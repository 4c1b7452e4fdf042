"""Suffix-array dedup: bytes covered by strings of a minimum length that also start earlier, removed.

Candidates come from repeats.py: places whose minimizer recurs, one of each content. Where they meet, a suffix array of all of them
gives their Burrows-Wheeler transform, and intervals of it are extended backwards breadth first, one symbol a round: a round sets the
common prefixes of the next value, and the rounds stop at the minimum length. What has no value by then is a common prefix of that
length at least, so that the suffixes between set values are the equal windows; all but the earliest of each go.

Defined cases: null and empty text, and texts shorter than the minimum, lose nothing; an empty table gives no rows; rows that repeat a
doc_id and a text are one document, and lose the same; rows of one doc_id with unlike texts are documents of their own, in order of a
digest of the text; of equal texts the smallest doc_id stays whole; a null doc_id comes before all others; other columns are ignored;
matches are of bytes, and never cross documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import hashing as H
from .repeats import Windows, removed


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of an array of symbols below 2**9, in the order of their first depth symbols at least; the end sorts first."""
    n, have = len(text), 7
    padded = np.zeros(n + have, np.int64)
    padded[:n] = text
    key = padded[:n].copy()
    for i in range(1, have):  # seven symbols to start from
        key <<= 9
        key |= padded[i : n + i]
    while True:
        order = np.argsort(key)
        ordered = key[order]
        new = np.ones(n, np.int64)
        new[1:] = ordered[1:] != ordered[:-1]
        ranks = np.cumsum(new)
        if have >= depth or ranks[-1] == n:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = ranks
        key = rank * (n + 1)
        key[: max(0, n - have)] += rank[have:]
        have *= 2


def short_prefixes(bwt: np.ndarray, stop: int, barrier: int = 0) -> np.ndarray:
    """True where a suffix shares fewer than stop symbols with the one before it in order.

    Breadth-first backward extension: the interval of each string of one length is extended by every symbol before it; where an
    extension ends, and no shorter string ended, the common prefix is that length. Intervals are arrays of bounds, so that a round is a
    few vector operations; an interval whose end was set before is not followed. No string goes beyond a barrier symbol."""
    n = len(bwt)
    order = np.argsort(bwt, kind="stable")
    keys = bwt[order].astype(np.int64) * (n + 1) + order  # by symbol, then place: a search counts the symbols before a place
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    lo, hi = np.array([0]), np.array([n])
    for _ in range(stop):
        width = hi - lo
        of = np.repeat(np.arange(len(lo)), width)
        at = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width) + lo[of]
        symbol = bwt[at].astype(np.int64)
        extends = symbol != barrier
        pair = symbol[extends] * len(lo) + of[extends]  # by symbol, so that the searches below go one way
        pair = np.unique(pair) if len(lo) < len(at) else np.sort(pair)
        symbol, of = np.divmod(pair, len(lo))
        lower = np.searchsorted(keys, symbol * (n + 1) + lo[of])
        upper = np.searchsorted(keys, symbol * (n + 1) + hi[of])
        fresh = ~known[upper]
        lo, hi = lower[fresh], upper[fresh]
        known[hi] = True
        if not len(lo):
            break
    return known[:n]


def earlier(body: np.ndarray, head: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows of the given places, those equal to one that starts earlier, as places and starts in the document."""
    length = head["length"].astype(np.int64)
    ends = np.cumsum(length + 1)
    text = np.zeros(int(ends[-1]), np.uint16)  # 0 ends every place
    owner = np.repeat(np.arange(len(head)), length)
    inner = np.arange(len(body)) - np.repeat(np.cumsum(length) - length, length)
    text[(ends - length - 1)[owner] + inner] = body.astype(np.uint16) + 1
    order = suffix_array(text, size)
    short = short_prefixes(text[order - 1], size)
    place = np.searchsorted(ends, order, side="right")
    offset = order - (ends - length - 1)[place]
    window = offset + size <= length[place]
    group = np.cumsum(short)[window]
    place, offset = place[window], offset[window]
    start = head["start"][place].astype(np.int64) + offset
    ordered = np.lexsort((start, head["key"][place], head["doc"][place], group))
    group, place, start = group[ordered], place[ordered], start[ordered]
    first = H.group_starts(group)
    of = place[np.repeat(first, np.diff(np.concatenate([first, [len(group)]])))]
    gone = (head["doc"][place] != head["doc"][of]) | (head["key"][place] != head["key"][of])
    gone |= start != np.repeat(start[first], np.diff(np.concatenate([first, [len(group)]])))
    return place[gone], start[gone]


def remove_earlier_strings(docs: DataFrame, length: int = 100, gram: int = 32) -> DataFrame:
    """A row for each document: its bytes, those removed, the removed spans and the bytes that stay."""
    return removed(docs, Windows(length, gram, False), True, earlier)
