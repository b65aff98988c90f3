"""Sharding by a k-d tree over document metadata, split at weighted medians."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard
from .ranking import rank_in

#: Bits of a position: the value's place on its axis, a hash that orders equal values, and a hash that parts repeated rows.
VALUE_BITS, HASH_BITS, COPY_BITS = 20, 32, 10
TIE_BITS = HASH_BITS + COPY_BITS
#: Sums of one histogram pass: so many bins a node, fewer where many nodes are open.
BINS, LEAST_BINS, SUMS = 4096, 16, 1 << 15
AXES = ("id", "size", "source", "lang")
_BOX = {"leaf": pa.int32(), "axis": pa.int32(), "lo": pa.int64(), "hi": pa.int64(), "step": pa.int64()}
_SPLIT = {"leaf": pa.int32(), "axis": pa.int32(), "at": pa.int64(), "high": pa.int32()}


@dataclass
class Node:
    """A box that is still to be split: the shards it becomes, its first shard's number, and the interval of its quantile."""

    shards: int
    first: int
    axis: int = 0
    lo: int = 0
    hi: int = 0
    below: float = 0.0
    goal: float = 0.0
    slack: float = 0.0
    at: int = 0

    def step(self, bins: int) -> int:
        return max(1, -(-(self.hi - self.lo) // bins))


def _axis(value: Column, low: float, high: float, key: str) -> Column:
    place = F.floor((value.cast("double") - low) / max(high - low, 1e-9) * (2**VALUE_BITS - 1)).cast("long")
    place = F.greatest(F.lit(0), F.least(F.lit(2**VALUE_BITS - 1), F.coalesce(place, F.lit(0))))
    tie = F.shiftrightunsigned(F.xxhash64(F.lit(key), F.col("doc_id"), F.col("text_crc32")), 64 - HASH_BITS)
    copy = F.shiftrightunsigned(F.xxhash64(F.lit(key), F.col("row")), 64 - COPY_BITS)
    return F.shiftleft(place, TIE_BITS).bitwiseOR(F.shiftleft(tie, COPY_BITS)).bitwiseOR(copy)


def positions(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """doc_id, size, text_crc32, leaf (0) and `a`, the row's positions on the axes; with the number of rows and their bytes."""
    crc = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary"))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).alias("text_crc32"),
        crc("source").alias("source_at"),
        crc("lang").alias("lang_at"),
        F.monotonically_increasing_id().alias("row"),
    )
    slim = cut(slim, "shard-sizes")
    s = slim.agg(
        F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("w"), F.coalesce(F.min("size"), F.lit(1)).alias("s0"), F.coalesce(F.max("size"), F.lit(1)).alias("s1"),
        F.coalesce(F.min("doc_id"), F.lit(0)).alias("d0"), F.coalesce(F.max("doc_id"), F.lit(0)).alias("d1"),
    ).first()
    scale = {
        "id": (F.col("doc_id"), s["d0"], s["d1"]),
        "size": (F.log2("size"), float(s["s0"].bit_length()) - 1, float((2 * s["s1"]).bit_length()) - 1),
        "source": (F.col("source_at"), 0, 2**32 - 1),
        "lang": (F.col("lang_at"), 0, 2**32 - 1),
    }
    placed = slim.select("doc_id", "size", "text_crc32", F.lit(0).alias("leaf"), F.array(*[_axis(*scale[a], a) for a in AXES]).alias("a"))
    out = cut(placed, "shard-positions")
    discard(slim)
    return out, s["n"], s["w"]


def _open(rows: DataFrame, todo: list[Node], slack: float) -> list[Node]:
    """The widest axis of each node, its interval there and the weight sought; nodes without rows are left out."""
    ends = [f(F.get("a", i)).alias(f"{n}{i}") for i in range(len(AXES)) for n, f in (("lo", F.min), ("hi", F.max))]
    stats = {r["leaf"]: r for r in rows.groupBy("leaf").agg(F.sum("size").alias("w"), *ends).collect()}  # one row a leaf
    found = []
    for node in todo:
        s = stats.get(node.first)
        if s is None:
            continue
        width = [(s[f"hi{i}"] >> TIE_BITS) - (s[f"lo{i}"] >> TIE_BITS) for i in range(len(AXES))]
        node.axis = max(range(len(AXES)), key=lambda i: (width[i], -i))
        node.lo, node.hi, node.below = s[f"lo{node.axis}"], s[f"hi{node.axis}"] + 1, 0.0
        node.goal, node.slack = s["w"] * (node.shards // 2) / node.shards, slack * s["w"] / node.shards
        found.append(node)
    return found


def _small(rows: DataFrame, kinds: dict[str, pa.DataType], values: list[tuple]) -> DataFrame:
    """A broadcast table of a row for each box of the tree, so that every pass runs the same code over other boxes."""
    columns = zip(*values, strict=True)
    return F.broadcast(rows.sparkSession.createDataFrame(pa.table({n: pa.array(c, k) for (n, k), c in zip(kinds.items(), columns, strict=True)})))


def _sums(rows: DataFrame, nodes: list[Node], bins: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The filled bins of each node's interval in order, with their weights and row counts: SUMS numbers in all at most."""
    boxes = [(n.first, n.axis, n.lo, n.hi, n.step(bins)) for n in nodes]
    held = rows.join(_small(rows, _BOX, boxes), "leaf").withColumn("p", F.get("a", F.col("axis"))).filter("p >= lo and p < hi")
    sums = held.groupBy("leaf", F.expr("(p - lo) div step").alias("bin")).agg(F.sum("size").alias("w"), F.count("*").alias("n")).toArrow()
    leaf, bin_, w, n = (sums.column(c).to_numpy() for c in ("leaf", "bin", "w", "n"))
    order = np.lexsort((bin_, leaf))
    leaf, bin_, w, n = leaf[order], bin_[order], w[order], n[order]
    at = {x.first: slice(*np.searchsorted(leaf, [x.first, x.first + 1])) for x in nodes}
    return {k: (bin_[x], w[x], n[x]) for k, x in at.items()}


def _medians(rows: DataFrame, todo: list[Node], slack: float) -> list[Node]:
    """Find the split of each node, all at once: its weighted quantile on its widest axis.

    Each pass narrows every open interval to the bin that holds the quantile, until that bin holds one row, weighs no
    more than the slack or is one position wide; the split is then the nearer edge of the bin.
    """
    found = _open(rows, todo, slack)
    left = list(found)
    while left:
        bins = max(LEAST_BINS, min(BINS, SUMS // len(left)))
        sums = _sums(rows, left, bins)
        still = []
        for node in left:
            bin_, weights, counts = sums[node.first]
            up = node.below + np.cumsum(weights)
            i = min(int(np.searchsorted(up, node.goal)), len(bin_) - 1)
            k, w, n, below, step = int(bin_[i]), int(weights[i]), int(counts[i]), float(up[i] - weights[i]), node.step(bins)
            start, end = node.lo + k * step, min(node.hi, node.lo + (k + 1) * step)
            if w <= node.slack or step == 1 or n == 1:
                node.at = start if node.goal - below <= below + w - node.goal else end
            else:
                node.lo, node.hi, node.below = start, end, below
                still.append(node)
        left = still
    return found


def leaves(rows: DataFrame, n_shards: int, slack: float) -> DataFrame:
    """rows with `leaf` as the number of the shard that each falls in."""
    todo = [Node(n_shards, 0)] if n_shards > 1 else []
    while todo:
        split = _medians(rows, todo, slack)
        moved = [(n.first, n.axis, n.at, n.first + n.shards // 2) for n in split]
        if moved:
            side = F.when(F.get("a", F.col("axis")) >= F.col("at"), F.col("high")).otherwise(F.col("leaf"))
            above = rows
            rows = cut(rows.join(_small(rows, _SPLIT, moved), "leaf", "left").select("doc_id", "size", "text_crc32", side.alias("leaf"), "a"), "shard-leaves")
            discard(above)
        halves = [h for n in todo for h in (Node(n.shards // 2, n.first), Node(n.shards - n.shards // 2, n.first + n.shards // 2))]
        todo = [h for h in halves if h.shards > 1]
    return rows


def shards(docs: DataFrame, n_shards: int | None = 40, target_bytes: int | None = None, slack: float = 0.002) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The axes are the document's id, size, source and language (the latter two by hash) on a scale of 2**20 places. A
    box that is to become k shards is split along its widest axis at the weighted quantile (k//2)/k of its bytes, found
    by distributed histograms; rows of equal value are ordered by a hash, so one value that holds a third of all rows is
    split like any other, and so are repeated rows. The boxes are split until each is one shard (`n_shards`, or as many
    as bring the mean to `target_bytes`). The law is `bytes`: each split is within `slack` of its quantile or within one
    document of it. size is the text's bytes (null: none) plus 16; text_crc32 is 0 for a null text. slot counts from 0
    without gaps in each shard, and its order is dealt by a hash of the whole place, row included, so that no task sorts
    all rows of one id. grown_shard is null, as the law is not `key`. Nulls of any column take the first place of
    their axis; repeated rows each get a slot; an empty table gives an empty result; further columns are ignored.

    The open boxes are a small broadcast table and each row carries the box it is in, written once a level to the shared
    folder; a pass returns at most SUMS sums to the driver (16 for each box where more than 2,048 boxes are open).
    """
    rows, n, weight = positions(docs)
    if target_bytes:
        n_shards = max(1, round(weight / target_bytes))
    if n:
        rows = leaves(rows, n_shards, slack)
    placed = rows.select("doc_id", "size", "text_crc32", F.col("leaf").alias("shard"), F.pmod(F.xxhash64("a"), F.lit(-(-n // 100_000) or 1)).alias("sub"), F.get("a", F.lit(0)).alias("at"))
    out = rank_in(placed, ["shard"], ["sub"], [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("at")], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
