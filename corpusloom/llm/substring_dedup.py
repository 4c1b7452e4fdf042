"""Substring dedup by level-wise doubling: words covered by windows that also occur elsewhere, removed, all copies alike.

Candidates come from repeats.py: places whose minimizer recurs, the first level; one place of each content. Where they meet, windows of
a short length are compared, and only those that recur are extended to twice that length, until the windows have the asked length or
none is left. A place that stands for several has all its windows repeated.

Defined cases: null and empty text, and texts with fewer words than a window, lose nothing; an empty table gives no rows; rows that
repeat a doc_id and a text are one document, and lose the same; rows of one doc_id, or of a null one, with unlike texts are documents
of their own; every one of equal texts of at least a window, under unlike doc_ids, loses all its words; other columns are ignored."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import hashing as H
from .repeats import Windows, removed


def elsewhere(body: np.ndarray, head: np.ndarray, size: int, first_level: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows of the given places, those that occur at another place too, as places and starts in the document."""
    length = head["length"].astype(np.int64)
    ends = np.cumsum(length)
    owner = np.repeat(np.arange(len(head)), length)
    left = np.repeat(ends, length) - np.arange(len(body))  # symbols up to the end of the place
    sums = H.prefix(body)
    many = (head["count"] > 1)[owner]
    level, alive = min(first_level, size), np.flatnonzero(left >= min(first_level, size))
    while True:
        values = H.windows(sums, alive, alive + level)
        _, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
        alive = alive[(counts[inverse] > 1) | many[alive]]
        if level == size or not len(alive):
            break
        longer = min(2 * level, size)
        repeated = np.zeros(len(body) + 1, bool)
        repeated[alive] = True
        alive = alive[(left[alive] >= longer) & repeated[np.minimum(alive + longer - level, len(body))]]
        level = longer
    alive = alive[~many[alive]]  # those are settled as a whole
    place = owner[alive]
    start = alive - (ends - length)[place]
    return place, head["start"][place].astype(np.int64) + start


def remove_repeated_windows(docs: DataFrame, length: int = 35, gram: int = 6, carry: bool = False) -> DataFrame:
    """A row for each document: its words, those removed, the removed spans and the words that stay, joined by single blanks."""
    return removed(docs, Windows(length, gram, True), False, elsewhere, carry=carry)
