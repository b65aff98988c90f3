"""The k-d tree against one built plainly over the same positions."""

from pyspark.sql import functions as F

from hirelake.llm import sharding

from .helpers import DOCS, read


def plain(points, shards, first=0):
    """point index -> shard: split along the axis of widest values at the nearer side of the weighted quantile."""
    if shards == 1 or not points:
        return {p[0]: first for p in points}
    wide = [max(a[i] >> sharding.TIE_BITS for _, _, a in points) - min(a[i] >> sharding.TIE_BITS for _, _, a in points) for i in range(len(sharding.AXES))]
    axis = wide.index(max(wide))
    points = sorted(points, key=lambda p: p[2][axis])
    goal, below, k = sum(w for _, w, _ in points) * (shards // 2) / shards, 0, 0
    while below + points[k][1] < goal:
        below += points[k][1]
        k += 1
    if goal - below > below + points[k][1] - goal:
        k += 1
    half = shards // 2
    return plain(points[:k], half, first) | plain(points[k:], shards - half, first + half)


def compare(docs, n_shards):
    rows, n, _ = sharding.positions(docs)
    held = sorted((tuple(r["a"]), r["doc_id"], r["size"], r["text_crc32"]) for r in rows.collect())
    want = plain([(i, size, a) for i, (a, _, size, _) in enumerate(held)], n_shards)
    got = sorted((tuple(r["a"]), r["leaf"]) for r in sharding.leaves(rows, n_shards, 0.0).collect())
    assert len(got) == n == len(want)
    assert got == [(held[i][0], want[i]) for i in range(n)]


def test_the_tree_is_the_plain_one(spark):
    docs = read(spark, "documents")
    compare(docs, 40)
    compare(docs.limit(37), 7)


def test_equal_values_and_repeated_rows_are_split(spark):
    rows = [(5, "the same text", "en", "hot", 13)] * 64 + [(i, "the same text", "en", "hot", 13) for i in range(64)]
    docs = spark.createDataFrame(rows, DOCS)
    compare(docs, 8)
    sizes = [r["count"] for r in sharding.shards(docs, 8, slack=0.0).groupBy("shard").count().collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 2


def test_shards_to_a_target(spark):
    docs = read(spark, "documents")
    total = sharding.shards(docs, 1).agg(F.sum("size")).first()[0]
    assert sharding.shards(docs, None, target_bytes=total // 12).select("shard").distinct().count() == 12

