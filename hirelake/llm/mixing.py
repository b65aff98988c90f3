"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import cut, join_spread, one_of_each, unused
from .ranking import hash32, leading, rank_in

WEIGHTS = (5, 2, 1)
#: Rows of one id from here on are laid by a hash of each row, not of the id, which they share.
MANY = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """One row per source: its size and target, by water filling.

    The sources, by code point with null last, weigh `weights` in turn and share the total size; a target stops at
    `most` times its source's size and the excess is shared again by weight. The capped sources are those of least
    cap per weight, so a running sum over the sources (a small table) finds the level at which none is above.
    """
    t = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    turn = F.row_number().over(W.Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    t = t.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    by_ratio = W.Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.Window.unboundedPreceding, -1)
    everything = W.Window.orderBy(F.lit(1)).rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    t = t.withColumn("level", left / weight_left).withColumn("_under", F.col("cap") / F.col("weight") > F.col("level"))
    level = F.max(F.when(F.col("_under"), F.col("level"))).over(everything)
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * level))
    return t.select("source", "source_size", "source_rows", target.cast("double").alias("target"))


def offset(source: Column, seed: str) -> Column:
    """A uniform number in [0, 1) that the seed and the source's name fix."""
    name = F.concat(F.lit(seed + ":"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: str = "mix") -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies, taken.

    Every document of a source has the same expected number of copies r = target / source_size (at most `most`). The
    source's documents are laid in order of size, then of a hash of the id and the id itself, each taking a length r;
    with one offset u in [0, 1) for the source, a document is emitted once per integer boundary that its stretch
    (rank*r + u, (rank+1)*r + u] crosses. In order of size, the words taken stay within about one document's size of
    the target. The offset comes from the seed and the source's name, and the order from nothing but the source's own
    rows, so reruns agree and other sources or more rows elsewhere change nothing; the number of rows decides only how
    many leading bits of the hash part the work.

    Sizes count words; a null text has size 0. A null source is a source of its own, the last one. A source without
    words has target 0 and no copies. Rows that repeat are separate documents. An empty table gives an empty result.
    """
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tie"), F.monotonically_increasing_id().alias("row"),
    )
    slim = cut(slim, "sizes")
    n = slim.count()
    sizes = slim.withColumn("named", F.col("source").isNotNull()).withColumn("name", F.coalesce("source", F.lit("")))
    many = sizes.groupBy("doc_id").agg(F.count("*").alias("_many")).filter(F.col("_many") >= MANY)
    place = hash32(F.col("doc_id"))
    if not many.isEmpty():
        null = F.col("doc_id").isNull()
        many = many.select(null.alias("_null"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.lit(True).alias("_many"))
        sizes = join_spread(sizes.withColumn("_null", null).withColumn("_id", F.coalesce("doc_id", F.lit(0))), many, ["_null", "_id"], F.col("row"), "left")
        place = F.when(F.col("_many"), F.shiftrightunsigned(F.xxhash64("tie", "row"), 32)).otherwise(place)
    sizes = sizes.withColumn("place", place).withColumn("tier", F.floor(F.log2(F.col("size") + 1.0) * 8).cast("int")).withColumn("sub", leading(F.col("place"), n))
    ranked = rank_in(sizes, ["named", "name"], ["tier", "size", "sub"], [F.col("place"), F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("row")])
    targets = source_targets(slim, weights, most).select(F.col("source").isNotNull().alias("named"), F.coalesce("source", F.lit("")).alias("name"), "source_size", "target")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    u = offset(F.col("source"), seed)
    crossed = F.floor((F.col("rank") + 1) * F.col("r") + u) - F.floor(F.col("rank") * F.col("r") + u)
    out = ranked.join(targets, ["named", "name"]).withColumn("r", ratio).withColumn("copies", crossed.cast("long"))
    return out.select("doc_id", "source", "tie", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each document's row as many times as it has copies; the columns stay as they are.

    Rows that share id, source and text count as one document with the copies of all of them; where they differ in
    other columns, the one of greatest hash over all columns stands for them. Further columns may have any name.
    """
    row, times, copy = unused(docs, "row_", "times_", "copy_")
    n = copies(docs, **options).groupBy("doc_id", "source", "tie").agg(F.sum("copies").alias(times)).filter(F.col(times) > 0)
    n = n.select(F.struct("doc_id", "source", "tie").alias(row), times)
    tie = F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tie")
    own = docs.columns
    docs = docs.withColumn(row, F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), tie))
    once = one_of_each(docs.join(n, row), row)
    return once.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*own)
