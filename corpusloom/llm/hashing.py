"""64-bit hashes of words, windows and sets of them, over many texts at once.

A text is an array of 64-bit symbols (its bytes or its words); prefix sums of symbol times power of an odd base, modulo 2**64, give the
hash of any window in constant time, and a mixer spreads it."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
BASE = pow(0x9E3779B97F4A7C15, 1, 1 << 64) | 1
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on each other (the finaliser of splitmix64)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, 1 << 20), base, dtype=U)
        full[0] = 1
        have = _powers[base] = np.cumprod(full, dtype=U)
    return have[:n]


BYTE_SYMBOLS = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
#: Words of more bytes are digested instead: powers modulo 2**64 have long strings (Thue-Morse ones) that always clash.
LONG_WORD = 127
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def prefix(symbols: np.ndarray) -> np.ndarray:
    out = np.empty(len(symbols) + 1, U)
    out[0] = 0
    np.cumsum(symbols * powers(BASE, len(symbols)), dtype=U, out=out[1:])
    return out


def windows(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the windows from start to end of the array whose prefix() is sums."""
    return mix((sums[end] - sums[start]) * powers(INVERSE, len(sums))[start])


def all_windows(sums: np.ndarray, size: int) -> np.ndarray:
    n = len(sums) - size
    return mix((sums[size:] - sums[:n]) * powers(INVERSE, n)) if n > 0 else np.empty(0, U)


def byte_array(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, one text after the other, and the texts' bounds."""
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of all texts, the texts' bounds in words, and where each word starts and ends in its text."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    space = SPACE[data]
    change = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = change[::2], change[1::2]
    at = 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)])
    bounds = np.searchsorted(start, at)
    hashes = windows(prefix(BYTE_SYMBOLS[data]), start, end)
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    offset = np.repeat(at[:-1], np.diff(bounds))
    return hashes, bounds, start - offset, end - offset


def group_starts(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values of a sorted array starts."""
    if not len(ordered):
        return np.empty(0, np.int64)
    return np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1])
