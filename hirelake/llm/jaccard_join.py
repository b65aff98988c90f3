"""Similarity self-join of texts on five-word shingles, with Bayesian pruning of MinHash candidates."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, digest, discard, join_spread, mix, one_of_each, runs, shingles, slices, unused, word_hashes
from .graph import components

HASHES, ROWS, BANDS = 64, 3, 21
#: Mean shingles a text at which a block of texts keeps its number of rows; blocks of longer texts have fewer.
SHINGLES = 4096
_SEED = np.random.default_rng(7919)
_A = _SEED.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _SEED.integers(0, 2**63, HASHES, dtype=np.uint64)
_SALT = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def minhash(sh: np.ndarray) -> np.ndarray:
    """64 minima of the shingle hashes under 64 linear maps."""
    out = np.full(HASHES, np.uint64(2**64 - 1))
    for at in range(0, len(sh), 4096):
        part = sh[at : at + 4096]
        out = np.minimum(out, (part[None, :] * _A[:, None] + _B[:, None]).min(axis=1))
    return out


def least_matches(threshold: float, tolerance: float, steps: tuple[int, ...]) -> list[tuple[int, int]]:
    """For each number n of compared values, the least number of matches that keeps a pair.

    With a uniform prior on the similarity s, the posterior after k matches of n is Beta(k+1, n-k+1), so
    P(s >= t) = P(Binomial(n+1, t) <= k). A pair is dropped once that falls below tolerance.
    """
    out = []
    for n in steps:
        tail, k = 0.0, -1
        while tail < tolerance:
            k += 1
            tail += math.comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k)
        out.append((n, k))
    return out


def spanning_edges(sig: np.ndarray, bars: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Edges (child, parent) of a spanning forest of the pairs that survive the pruning; at most one per row."""
    left = np.arange(1, len(sig))
    queue, edges = [0], []
    while len(left):
        x = queue.pop() if queue else None
        if x is None:
            x, left = int(left[0]), left[1:]
        alive, hits, done = left, np.zeros(len(left), np.int32), 0
        for n, bar in bars:
            hits = hits + (sig[alive, done:n] == sig[x, done:n]).sum(axis=1)
            ok = hits >= bar
            alive, hits, done = alive[ok], hits[ok], n
            if not len(alive):
                break
        if len(alive):
            edges += [(int(y), x) for y in alive]
            queue += alive.tolist()
            left = np.setdiff1d(left, alive, assume_unique=True)
    return edges


def _sketch(batches):
    for rb in slices(batches):
        rid, text = rb.column("rid"), rb.column("text").to_pylist()
        key, n, sig, bands = [], [], [], []
        for t in text:
            words = word_hashes(t)
            sh = shingles(words)
            key.append(digest(words))
            n.append(len(sh))
            if len(sh):
                m = minhash(sh)
                sig.append((mix(m) & np.uint64(0xFFFF)).astype(np.uint16).tobytes())
                g = m[: BANDS * ROWS].reshape(BANDS, ROWS)
                h = _SALT.copy()
                for j in range(ROWS):
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + g[:, j])
                bands.append(h.view(np.int64).tolist())
            else:
                sig.append(None)
                bands.append([])
        yield pa.RecordBatch.from_arrays(
            [rid, rb.column("hash"), rb.column("doc_id"), pa.array(key, pa.binary()), pa.array(n, pa.int32()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            names=["rid", "hash", "doc_id", "key", "n", "sig", "bands"],
        )


def _candidates(bars):
    def run(batches):
        for group in runs(batches, ["bh", "g"]):
            if len(group) < 2:
                continue
            keys = group["key"].tolist()
            sig = np.frombuffer(b"".join(group["sig"]), np.uint16).reshape(len(keys), HASHES)
            e = spanning_edges(sig, bars)
            if e:
                yield pa.RecordBatch.from_arrays([pa.array([keys[x] for x, _ in e], pa.binary()), pa.array([keys[y] for _, y in e], pa.binary())], names=["a", "b"])

    return run


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted sets; shingles that only one set has play no part."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    renumber = np.cumsum(count > 1) - 1
    owner, column = owner[shared], renumber[column[shared]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = max(256, (1 << 23) // max(1, len(sets)))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        m = np.zeros((len(sets), min(width, int(column[hi - 1]) - at + 1) if hi > lo else 1), np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        out += m @ m.T
    return out


def _verify(threshold: float):
    """For each block pair of a cluster: exact similarity of its pairs, summed to one row per text, with a spanning forest."""

    def run(batches):
        for group in runs(batches, ["comp", "g"]):
            if len(group) < 2:
                continue
            keys, weight, block = group["key"].tolist(), group["weight"].to_numpy(), group["block"].to_numpy()
            sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
            size = np.array([len(s) for s in sets])
            if len(sets) == 2:
                both = len(np.intersect1d(*sets, assume_unique=True))
                linked = np.zeros((2, 2), bool)
                linked[0, 1] = linked[1, 0] = both >= threshold * (size.sum() - both) - 1e-9
            else:
                both = _overlaps(sets)
                both = both.astype(np.float64)
                linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-6
                np.fill_diagonal(linked, False)
            if group["cross"].iloc[0]:  # pairs within one block are counted where it stands alone
                linked &= block[:, None] != block[None, :]
            links = linked @ weight
            root = np.arange(len(keys))
            for i in range(len(keys)):
                seen, queue = {i}, [i]
                if root[i] != i or not linked[i].any():
                    continue
                while queue:
                    x = queue.pop()
                    for y in np.flatnonzero(linked[x]).tolist():
                        if y not in seen:
                            seen.add(y)
                            if root[y] == y and y > i:
                                root[y] = i
                                queue.append(y)
            at = np.flatnonzero(links > 0).tolist()
            if at:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[i] for i in at], pa.binary()), pa.array([int(links[i]) for i in at], pa.int64()), pa.array([keys[root[i]] for i in at], pa.binary())],
                    names=["key", "links", "root"],
                )

    return run


def _shingled(batches):
    """The texts' shingle hashes, for those whose words are the class's own (one id may stand on different texts)."""
    for rb in slices(batches):
        sets = []
        for key, text in zip(rb.column("key").to_pylist(), rb.column("text").to_pylist(), strict=True):
            words = word_hashes(text)
            sets.append(shingles(words).tobytes() if digest(words) == key else None)
        columns = [rb.column(c) for c in rb.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(sets, pa.binary())], names=[*(c for c in rb.schema.names if c != "text"), "shingles"])


def _blocks(df: DataFrame, blocks, *group: str) -> DataFrame:
    """Deal the members of each group into its number of blocks and pair every two blocks of a group.

    Column g numbers the pair, cross tells two different blocks from one with itself. No pair of members is missed, and
    each stands in one pair of blocks: within a block where cross is false, else across.
    """
    nb = F.greatest(F.lit(1), F.ceil(blocks)).cast("int")
    df = df.withColumn("nb", nb).withColumn("block", F.pmod(F.xxhash64("key"), F.col("nb")).cast("int"))
    df = df.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    pair = F.least("x", "block") * F.col("nb") + F.greatest("x", "block")
    return df.withColumn("g", pair).withColumn("cross", F.col("x") != F.col("block")).drop("x", "nb")


def _dealt(df: DataFrame, work: int, keys: list[str], a_task: int) -> DataFrame:
    """df in runs of equal keys over as many tasks as `work`, the comparisons to be made, asks for.

    The number is given, as rows joined by bytes alone would leave the quadratic work to a few tasks.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = min(200_000, max(least, -(-work // a_task)))
    return df.repartition(n, *keys).sortWithinPartitions(*keys)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6, bucket: int = 512, block: int = 512) -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links, kept; rid is the id, or a hash of the
    text where it is null, and class_rid the same for the class; hash tells the texts of one id apart, label the classes.

    Texts are compared as sets of five-word shingles (words in lower case, split at white space); a text of one to four
    words is one shingle. Two documents are linked when the Jaccard similarity of their sets is at least `threshold`.
    n_links counts the other documents linked directly, copies included; class_id is the least doc_id that links reach.

    Candidates share three MinHash values in one of 21 bands (a pair at similarity 0.8 is missed with probability
    0.488^21 < 3e-7). They are compared 16 values at a time and dropped when the posterior probability of reaching the
    threshold falls under `tolerance`; the survivors' clusters are verified exactly, in blocks, and every link counts.
    Pairs are never rows: a bucket yields a spanning forest, a block pair one count for each text.

    Null and empty texts (and those of white space) have no shingles: they are copies of one another and link with
    nothing else. Repeated rows each get a row, and texts that share a doc_id are compared each for itself. A null doc_id takes part; its class has the least non-null id, if any.
    `kept` marks the rows whose id is the class's (where no row of a class has an id, those with its least rid). An empty table gives an empty result; further columns are ignored.
    """
    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("rid"), F.xxhash64("text").alias("hash"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = "rid long, hash long, doc_id long, key binary, n int, sig binary, bands array<bigint>"
    rows = cut(slim.mapInArrow(_sketch, kind).withColumn("row", F.monotonically_increasing_id()), "sketch")
    classes = rows.groupBy("key").agg(
        F.min(F.struct("rid", "hash")).alias("rep"), F.min("doc_id").alias("least"), F.count("*").alias("weight"),
        F.max("n").alias("n"), F.max("sig").alias("sig"), F.max("bands").alias("bands"),
    )
    classes = cut(classes, "classes")

    held = classes.select("key", F.explode("bands").alias("bh"))
    shared = cut(held.groupBy("bh").agg(F.count("*").alias("m")).filter("m > 1"), "buckets")
    work = shared.agg(F.sum(F.col("m") * F.least(F.col("m"), F.lit(2 * bucket)))).first()[0] or 0
    members = join_spread(held, shared, ["bh"], F.col("key")).join(classes.select("key", "sig"), "key")
    members = _blocks(members, F.col("m") / bucket, "bh").select("bh", "g", "key", "sig")
    bars = least_matches(threshold, tolerance, (16, 32, 48, 64))
    candidate = _dealt(members, work, ["bh", "g"], 50_000_000).mapInArrow(_candidates(bars), "a binary, b binary")
    cluster = cut(components(candidate).select(F.col("node").alias("key"), F.col("label").alias("comp")), "clusters")
    discard(shared)

    part = cluster.join(classes.select("key", "rep", "weight", "n"), "key")
    sizes = part.groupBy("comp").agg(F.count("*").alias("m"), F.sum("n").alias("all"))
    sizes = cut(sizes.select("comp", F.greatest(F.col("m") / block, F.col("all") / (block * SHINGLES)).alias("nb"), "m", "all"), "cluster-sizes")
    work = sizes.agg(F.sum(F.col("all") * F.greatest(F.lit(1.0), F.col("nb")) * F.least(F.col("m"), F.lit(block)))).first()[0] or 0
    part = join_spread(part, sizes, ["comp"], F.col("key"))
    part = part.select("comp", "nb", "key", "weight", F.col("rep.rid").alias("rid"), F.col("rep.hash").alias("hash"))
    texts = slim.select("rid", "hash", "text").join(part, ["rid", "hash"]).select("comp", "nb", "key", "weight", "text")
    texts = texts.mapInArrow(_shingled, "comp binary, nb double, key binary, weight long, shingles binary").filter("shingles is not null").dropDuplicates(["key"])
    texts = _blocks(texts, F.col("nb"), "comp").select("comp", "g", "cross", "key", "weight", "block", "shingles")
    found = _dealt(texts, int(work), ["comp", "g"], 200_000_000).mapInArrow(_verify(threshold), "key binary, links long, root binary")
    found = cut(found, "links")
    discard(sizes)
    label = components(found.select(F.col("key").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("key"), "label")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    named = classes.select("key", "least", "rep", "weight").join(links, "key", "left").join(label, "key", "left").withColumn("label", F.coalesce("label", "key"))
    named = cut(named, "named")
    ids = named.groupBy("label").agg(F.min("least").alias("class_id"), F.min("rep.rid").alias("first_rid"))
    ids = ids.withColumn("class_rid", F.coalesce("class_id", "first_rid"))
    named = join_spread(named, ids, ["label"], F.col("key")).select("key", "label", "class_id", "class_rid", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = join_spread(rows.select("rid", "hash", "doc_id", "key", "row"), named, ["key"], F.col("row"))
    return out.select("doc_id", "class_id", "n_links", (F.col("rid") == F.col("class_rid")).alias("kept"), "rid", "class_rid", "hash", "label")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs less all but one of each class of near duplicates; the columns stay as they are.

    Of the class's rows with the kept id, one with the text of least hash stays; where rows of one id and text differ in
    other columns, that of greatest hash over all columns. Further columns may have any name.
    """
    rid, text = unused(docs, "rid_", "text_")
    kept = near_duplicates(docs, **options).filter("kept").groupBy("label").agg(F.min(F.struct("rid", "hash")).alias("row"))
    chosen = kept.select(F.col("row.rid").alias(rid), F.col("row.hash").alias(text)).distinct()
    docs = docs.withColumn(rid, F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))).withColumn(text, F.xxhash64("text"))
    left = docs.join(chosen, [rid, text], "left_semi")
    return one_of_each(left, rid, text).drop(rid, text)  # by the join's own columns: the texts are not dealt again
