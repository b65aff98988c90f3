"""The filter audit and the centroid clustering against plain Python."""

import hashlib
import math
import re
from collections import Counter
from itertools import permutations

import numpy as np

from hirelake.llm import centroids, filter_audit

from .helpers import DOCS, awkward, empty, read

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"


def plain_audit(docs, labels):
    docs = [(r.doc_id, r.source or "", r.text or "") for r in docs]
    quality, toxic = ({r.doc_id for r in labels if r[k] == 1 and r.doc_id is not None} for k in ("quality", "toxic"))
    least = {}
    for i, _, t in docs:
        if i is not None:
            least[t] = min(i, least.get(t, i))

    def fails(i, t):
        w = WORD.findall(t)
        yes = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > least[t]]
        return {f for f, y in zip("ABCDE", yes, strict=True) if y}

    docs = [(i, p, fails(i, t)) for i, p, t in docs]
    out, total = {}, Counter()
    for part in {p for _, p, _ in docs}:
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[1] == part]
            gone = []
            for step, f in enumerate(order, 1):
                fell = [d for d in left if f in d[2]]
                left = [d for d in left if f not in d[2]]
                only = sum(d[2] == {f} for d in docs if d[1] == part)
                out[part, order, step] = [len(left), len(fell), sum(f in d[2] for d in gone), only, sum(d[0] in quality for d in fell), sum(d[0] in toxic for d in fell)]
                gone += fell
                total[part, f] += len(fell)
    return {k: tuple(v) + (total[k[0], k[1][k[2] - 1]],) for k, v in out.items()}


def rows_of(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_audit_of_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (4, 1, None), (None, 1, 1), (5, None, 1)], LABELS)
    docs = awkward(spark)
    got = filter_audit.audit(docs, labels)
    assert got.count() == 600 * 4
    assert rows_of(got) == plain_audit(docs.collect(), labels.collect())
    assert filter_audit.audit(empty(spark), labels).count() == 0
    assert filter_audit.audit(docs, labels.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0


def test_audit_of_real_rows_in_more_parts_than_are_held(spark, monkeypatch):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    want = plain_audit(docs.collect(), labels.collect())
    assert rows_of(filter_audit.audit(docs, labels)) == want
    # the sums may go out in pieces: plain data in, so that the smaller bound acts in this process
    judged = filter_audit.judged(docs, labels).toArrow().to_batches(max_chunksize=37)
    monkeypatch.setattr(filter_audit, "HELD", 3)
    pieces = list(filter_audit._count(iter(judged)))
    removed = Counter()
    for rb in pieces:
        for r in rb.to_pylist():
            removed[r["part"], filter_audit.ORDERS[r["o"]], r["s"] + 1] += r["removed"]
    assert len(pieces) > 20 and dict(removed) == {k: v[1] for k, v in want.items()}


def test_audit_hot_group(spark):
    """One row of one id and text many times, and many ids of one text."""
    docs = spark.createDataFrame([(7, "same text", "en", "a", 9)] * 500 + [(i, "same text", "en", "a", 9) for i in range(300)] + [(None, "same text", "en", None, 9)] * 50, DOCS)
    got = rows_of(filter_audit.audit(docs, spark.createDataFrame([], LABELS)))
    assert got["a", "EABCD", 1][:2] == (1, 799) and got["", "EABCD", 1][:2] == (50, 0)


def plain_clusters(rows, k=8, rounds=10):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(x) < 131072 for x in v):
            kept.append((i, [math.floor(1024 * x) for x in v]))
    seeds = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centres = [list(v) for _, v in seeds]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((distance(v, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(centres)):
            own = [v for (_, v), o in zip(kept, of, strict=True) if o == j]
            if own:
                centres[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    last = [(i, *near(v)[::-1]) for i, v in kept]
    by = Counter()
    for _, j, d in last:
        by[j] += d
    return sorted((str(i), j, d, by[j], sum(by.values()), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for i, j, d in last)


def clusters(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroids.clustered(df).collect())


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_clusters_with_ties_repeats_and_unfit_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.integers(-2, 3, 64) / 1024]) for i in range(300)]  # coarse values: many ties
    rows += [(1, rows[0][1]), (1, rows[0][1]), (None, rows[3][1]), (900, None), (901, [0.5] * 63), (902, [0.5] * 63 + [None]), (903, [math.nan] * 64), (904, [math.inf] * 64), (905, [1e300] * 64), (906, []), (907, [-0.0001] * 64)]
    assert clusters(vectors(spark, rows)) == plain_clusters(rows)
    from pyspark.sql import functions as F

    clash = vectors(spark, rows).select("*", F.lit("x").alias("cluster"), F.lit(1).alias("ids"), F.lit(2).alias("v"))
    assert clusters(clash) == plain_clusters(rows)


def test_few_vectors_equal_vectors_and_none(spark):
    few = [(i, [float(i)] * 64) for i in range(3)]
    assert clusters(vectors(spark, few)) == plain_clusters(few)
    same = [(i, [0.25] * 64) for i in range(40)]
    assert clusters(vectors(spark, same)) == plain_clusters(same)
    for rows in ([], [(1, None)]):
        assert clusters(vectors(spark, rows)) == []


def test_bounds_decide_most_vectors_and_never_wrongly():
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((4000, 64)) * 20 + rng.integers(0, 8, 4000)[:, None] * 300).astype(np.int64)
    before = x[rng.choice(4000, 8, replace=False)]
    near, upper, lower = centroids.Step(before).scan(x)
    scanned = []
    for _ in range(6):
        centres = np.array([x[near == j].sum(0) // max(1, (near == j).sum()) if (near == j).any() else before[j] for j in range(8)])
        near, upper, lower, n = centroids.Step(centres, before).assign(x, near, upper, lower)
        assert (near == centroids.Step(centres).scan(x)[0]).all()
        scanned.append(n)
        before = centres
    assert scanned[-1] < 400
