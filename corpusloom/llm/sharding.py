"""K-d tree partitioning: rows are split at distributed weighted medians along the widest metadata dimension, down to shards.

A node that stands for several shards is split where its rows' bytes divide in the ratio of the two sides' shards. A dimension gives each
row a key: the value's place in the column's range in the upper bits, a hash of doc_id below, so that even a value that a third of the rows have can be split.
The place of a split is found digit by digit: one aggregation of a few thousand sums a node and digit, for all nodes of a level at once,
until the bytes in doubt are a thousandth of a shard. The driver sees these sums and the tree, whose sizes do not depend on the rows.

Defined cases: null text has no bytes and the crc of none; null metadata are one value, below all others; rows that repeat are put apart
from one another like any others; an empty table gives no rows; columns other than the named dimensions are ignored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .base import saved

CODE, TIE, DIGIT = 31, 31, 12
BITS = CODE + TIE
INTEGRAL = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)


@dataclass
class Node:
    """A part of the tree: its shards are first to first + shards - 1."""

    first: int
    shards: int
    key: str = ""
    cut: int = 0
    left: Node | None = None
    right: Node | None = None

    def leaves(self) -> list[Node]:
        return [self] if self.left is None else [*self.left.leaves(), *self.right.leaves()]

    def expression(self) -> Column:
        """The first shard of the leaf that a row belongs to."""
        if self.left is None:
            return F.lit(self.first)
        return F.when(F.col(self.key) < self.cut, self.left.expression()).otherwise(self.right.expression())


#: Bytes of a text value that order it, after what all values of the column begin with.
SHOWN = 7


def in_order(docs: DataFrame, dimensions: list[str]) -> dict[str, Column]:
    """Each dimension as a number that keeps the order of its values: numbers themselves, and of others the bytes after the beginning that
    the least and the greatest value, and so all values, have in common."""
    numeric = {d for d in dimensions if isinstance(docs.schema[d].dataType, (*INTEGRAL, T.DoubleType, T.FloatType))}
    raw = {d: F.encode(F.col(d).cast("string"), "UTF-8") for d in dimensions if d not in numeric}
    ends = docs.agg(*[f(F.substring(c, 1, 1024)).alias(f"{n}_{d}") for d, c in raw.items() for n, f in (("lo", F.min), ("hi", F.max))]).first() if raw else None
    out = {d: F.col(d).cast("double") for d in numeric}
    for d, c in raw.items():
        lo, hi = bytes(ends[f"lo_{d}"] or b""), bytes(ends[f"hi_{d}"] or b"")
        common = next((i for i, (x, y) in enumerate(zip(lo, hi, strict=False)) if x != y), min(len(lo), len(hi)))
        out[d] = F.conv(F.rpad(F.hex(F.substring(c, common + 1, SHOWN)), 2 * SHOWN, "0"), 16, 10).cast("double")
    return out


def keys_of(docs: DataFrame, dimensions: list[str]) -> dict[str, Column]:
    """A 62-bit key for each dimension: its order, scaled to the table's range, so that widths of unlike dimensions can be compared."""
    order = in_order(docs, dimensions)
    span = docs.agg(*[f(c).alias(f"{n}_{d}") for d, c in order.items() for n, f in (("lo", F.min), ("hi", F.max))]).first()
    tie = F.shiftrightunsigned(F.xxhash64(F.col("doc_id")), 64 - TIE)
    out = {}
    for d in dimensions:
        lo, hi = span[f"lo_{d}"] or 0.0, span[f"hi_{d}"] or 0.0
        code = (F.lit(1) + F.floor((order[d] - lo) / ((hi - lo) or 1.0) * ((1 << CODE) - 2))).cast("long")
        out[d] = F.shiftleft(F.coalesce(F.when(F.col(d).isNotNull(), code), F.lit(0)).cast("long"), TIE).bitwiseOR(tie)
    return out


def widest(rows: DataFrame, nodes: list[Node], at: Column, keys: list[str]) -> dict[int, tuple[str, int]]:
    """For each node the dimension over which its rows spread furthest, and its bytes."""
    sums = rows.groupBy(at.alias("node")).agg(F.sum("size").alias("bytes"), *[(F.max(k) - F.min(k)).alias(k) for k in keys]).collect()
    return {r["node"]: (max(keys, key=lambda k: (r[k], k)), r["bytes"]) for r in sums}


def split(rows: DataFrame, root: Node, nodes: list[Node], keys: list[str], doubt: float) -> None:
    """Splits each of the nodes, all of which are leaves with several shards."""
    at = root.expression()
    spread = widest(rows, nodes, at, keys)
    todo = {}
    for n in nodes:
        key, total = spread.get(n.first, (keys[0], 0))
        n.key = key
        todo[n.first] = {"node": n, "prefix": 0, "below": 0, "target": total * (n.shards // 2) / n.shards}
    shift = BITS
    while todo and shift > 0:
        step = min(DIGIT, shift)
        shift -= step
        digit, here = F.lit(None).cast("long"), F.lit(False)
        for first, s in todo.items():
            mine = (at == first) & (F.shiftright(F.col(s["node"].key), shift + step) == s["prefix"])
            digit = F.when(mine, F.shiftright(F.col(s["node"].key), shift).bitwiseAND((1 << step) - 1)).otherwise(digit)
            here = here | mine
        sums: dict[int, list[tuple[int, int]]] = {}
        for r in rows.where(here).groupBy(at.alias("node"), digit.alias("digit")).agg(F.sum("size").alias("bytes")).collect():
            sums.setdefault(r["node"], []).append((r["digit"], r["bytes"]))
        for first, s in list(todo.items()):
            below, chosen = s["below"], None
            for d, b in sorted(sums.get(first, [])):
                chosen = (d, b)
                if below + b > s["target"]:
                    break
                below += b
            if chosen is None:
                s["node"].cut = s["prefix"] << (shift + step)
                del todo[first]
                continue
            s["prefix"], s["below"] = s["prefix"] << step | chosen[0], below
            over = below + chosen[1] - s["target"]
            if chosen[1] <= doubt or shift == 0:
                s["node"].cut = (s["prefix"] + (abs(over) < s["target"] - below)) << shift
                del todo[first]
    for n in nodes:
        half = n.shards // 2
        n.left, n.right = Node(n.first, half), Node(n.first + half, n.shards - half)


def shard(docs: DataFrame, shards: int = 24, dimensions: tuple[str, ...] = ("source", "lang", "n_chars")) -> DataFrame:
    """A row for each row: doc_id, size, text_crc32, shard and slot, its place in the shard from 0 on."""
    text = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    keys = keys_of(docs, list(dimensions))
    names = {d: f"key{i}" for i, d in enumerate(keys)}
    rows = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.spark_partition_id().alias("part"), *[k.alias(names[d]) for d, k in keys.items()]), "rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    root = Node(0, shards)
    while todo := [n for n in root.leaves() if n.shards > 1]:
        split(rows, root, todo, list(names.values()), total / shards / 1000)
    placed = rows.select("doc_id", "size", "text_crc32", "part", root.expression().cast("int").alias("shard"))
    counts = placed.groupBy("shard", "part").count()
    before = counts.select("shard", "part", (F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count")).alias("before"))
    within = placed.withColumn("within", F.row_number().over(Window.partitionBy("part", "shard").orderBy("doc_id", "text_crc32")))
    return within.join(before, ["part", "shard"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("within") - 1).cast("long").alias("slot"))
