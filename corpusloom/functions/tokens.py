"""Column expressions over token arrays, pieces and pair keys. Everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_tokens(text: Column | str) -> Column:
    """A text's UTF-8 bytes as array<int>."""
    h = F.hex(F.encode(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "UTF-8"))
    return F.transform(F.regexp_extract_all(h, F.lit("(..)"), F.lit(1)), lambda x: F.conv(x, 16, 10).cast("int"))


def with_bounds(tokens: Column, bos: int | None, eos: int | None) -> Column:
    """Tokens between a start and an end token, either of which may be missing."""
    edge = lambda t: [F.array(F.lit(t))] if t is not None else []
    return F.concat(*edge(bos), tokens, *edge(eos))


def valid(tokens: Column) -> Column:
    """Without padding, which is negative."""
    return F.filter(tokens, lambda t: t >= 0)


def overflows(tokens: Column, width: int = 65535) -> Column:
    return F.size(tokens) > width


def checked_id(token: Column) -> Column:
    """The id itself; an error beyond 32 unsigned bits."""
    return F.when((token < 0) | (token > 0xFFFFFFFF), F.raise_error(F.lit("token id exceeds 32 bits"))).otherwise(token)


def pair_key(left: Column, right: Column) -> Column:
    return F.shiftleft(left.cast("bigint"), 32).bitwiseOR(right.cast("bigint"))


def key_left(key: Column) -> Column:
    return F.shiftright(key, 32)


def key_right(key: Column) -> Column:
    return key.bitwiseAND(0xFFFFFFFF)


def adjacent_pairs(tokens: Column) -> Column:
    """Keys of all adjacent pairs, in order."""
    n = F.size(tokens)
    return F.when(n > 1, F.zip_with(F.slice(tokens, 1, F.greatest(n - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(n - 1, F.lit(0))), pair_key)).otherwise(F.array().cast("array<bigint>"))


def windows(tokens: Column, n: Column | int) -> Column:
    """All windows of n tokens, in order."""
    n = F.lit(n) if isinstance(n, int) else n
    last = F.size(tokens) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.slice(tokens, i, n))).otherwise(F.array().cast("array<array<int>>"))


def collapse(tokens: Column, left: int, right: int, new: int) -> Column:
    """The trainer's merge: where a pair stands, its left becomes the new token and its right goes; a run of one token becomes one.

    The tokens are bound once, as the element of an array of one, and zipped with their neighbours."""

    def merged(x: Column) -> Column:
        n, none = F.size(x), F.array(F.lit(None).cast("int"))
        before, after = F.slice(F.concat(none, x), 1, n), F.concat(F.slice(x, 2, F.greatest(n - 1, F.lit(0))), none)
        around = F.zip_with(before, after, lambda p, q: F.struct(F.coalesce(p == left, F.lit(False)).alias("l"), F.coalesce(q == right, F.lit(False)).alias("r")))
        both = F.zip_with(x, F.slice(around, 1, n), lambda t, a: F.when((t == right) & a["l"], -1).when((t == left) & a["r"], new).otherwise(t))
        return F.filter(both, lambda t: t != -1)

    return F.get(F.transform(F.array(tokens), merged), F.lit(0))


def greedy(tokens: Column, left: int, right: int, new: int) -> Column:
    """The evaluator's merge: left to right, without overlap."""
    step = lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1) == left) & (x == right), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.lit(new)))).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(tokens, F.array().cast("array<int>"), step)


def merge_hash(salt: str, left: Column, right: Column) -> Column:
    """SHA-256 of a salt and both ids as big-endian 64-bit integers."""
    wide = lambda c: F.unhex(F.lpad(F.hex(c.cast("bigint")), 16, "0"))
    return F.sha2(F.concat(F.encode(F.lit(salt), "UTF-8"), wide(left), wide(right)), 256)


def alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: shown ones for themselves, the others from 256 on in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def token_string(piece: Column) -> Column:
    """A piece of bytes in the printable alphabet."""
    table = F.array(*[F.lit(alphabet()[b]) for b in range(256)])
    codes = F.transform(F.regexp_extract_all(F.hex(piece), F.lit("(..)"), F.lit(1)), lambda h: F.element_at(table, F.conv(h, 16, 10).cast("int") + 1))
    return F.array_join(codes, "")


def string_piece(token: Column) -> Column:
    """The bytes of a token in the printable alphabet."""
    table = alphabet()
    back = F.create_map(*[x for b, c in table.items() for x in (F.lit(c), F.lit(f"{b:02X}"))])
    return F.unhex(F.array_join(F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.element_at(back, c)), ""))


def piece_text(piece: Column) -> Column:
    """A piece as text: bytes as Latin-1, blanks as lower one eighth blocks."""
    return F.replace(F.decode(piece, "ISO-8859-1"), F.lit(" "), F.lit("▁"))


def text_piece(text: Column) -> Column:
    return F.encode(F.replace(text, F.lit("▁"), F.lit(" ")), "ISO-8859-1")


def names_of(listed: Column) -> Column:
    """A comma list's names, trimmed, lower-cased, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(listed, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")))


def finite(value: Column) -> Column:
    """Null instead of NaN and infinities, as JSON wants it."""
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), None).otherwise(value)


def cosine(x: Column, y: Column) -> Column:
    """Cosine similarity over the shorter length; -1 for empty vectors and zero norms."""
    n = F.least(F.size(x), F.size(y))
    a, b = F.slice(x, 1, F.greatest(n, F.lit(0))), F.slice(y, 1, F.greatest(n, F.lit(0)))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e.cast("double"))
    dot = total(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")))
    norm = F.sqrt(total(F.transform(a, lambda e: e.cast("double") * e.cast("double"))) * total(F.transform(b, lambda e: e.cast("double") * e.cast("double"))))
    return F.when((n <= 0) | (norm == 0), F.lit(-1.0)).otherwise(dot / norm)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def dtype_name(width: Column) -> Column:
    """The integer type that holds lengths up to a width."""
    return F.when(width <= 65535, "uint16").otherwise("int32")
