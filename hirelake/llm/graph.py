"""Connected components over an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import cut, discard


def _with_least(pairs: DataFrame, salts: int) -> DataFrame:
    """pairs (u, v) with m = the least of u and all its v.

    A node's pairs are dealt by a salt of v, so that the centre of a star is spread like any other rows. The least of
    each part is found where its pairs are; the parts of a node, no more than there are salts, then agree on theirs and
    are joined back to their own pairs.
    """
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int"))
    part = pairs.groupBy("u", "salt").agg(F.min("v").alias("m0"))
    part = part.select("u", "salt", F.min("m0").over(W.Window.partitionBy("u")).alias("m0"))
    return pairs.join(part, ["u", "salt"]).select("u", "v", F.least("u", "m0").alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """Columns node, label: the least node reachable, for every node of an edge. Self edges are ignored.

    Each round links every node's larger neighbours to its least neighbour, then every node's smaller ones, until the
    edge set is a star about each least node. The edges never leave the cluster; each round is cut to the shared folder.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    pairs = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before, n = None, pairs.count()
    most = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(max_rounds):
        salts = min(most, max(8, int(n**0.5) // 8))  # a centre's pairs a part and its parts both stay few
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, salts).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = _with_least(large, salts)  # every v is the lesser end here
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        last = pairs
        pairs = cut(small.filter("u <> v").distinct(), "edges")
        discard(last)
        now = pairs.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(xxhash64(v, u) as decimal(20,0)))")).first()
        if now == before:
            break
        before, n = now, now[0]
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
