"""Centroid clustering of integer vectors with Hamerly's bounds."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard

DIM, CENTRES, ROUNDS, SCALE, BLOCK = 64, 8, 10, 1024, 4096
#: Components from here on (|x| of 131,072 and more) would not leave a squared distance inside 64 bits.
REACH = 1 << 27
#: Relative slack that covers the rounding of square roots and of running sums of drifts.
SLACK = 1e-12
STATE = "ids array<long>, points binary, cluster binary, upper binary, lower binary, sums binary"
_NAMES = ["ids", "points", "cluster", "upper", "lower", "sums"]


def whole(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the vectors take part, and floor(SCALE * x) of those, as 64-bit integers."""
    fits = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False))
    flat = vectors.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null component reads as NaN
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(flat.reshape(-1, dim) * SCALE)
    good = (np.abs(scaled) < REACH).all(axis=1)
    fits[np.flatnonzero(fits)[~good]] = False
    return fits, scaled[good].astype(np.int64)


def seed_key(vec_id: int) -> str:
    return hashlib.sha256(f"3:{vec_id}".encode()).hexdigest()


def _pack(dim: int, k: int):
    """Blocks of vectors without a cluster yet; each names its k first candidates for a starting centroid."""

    def run(batches):
        for rb in batches:
            for at in range(0, rb.num_rows, BLOCK):
                part = rb.slice(at, BLOCK)
                fits, x = whole(part.column("v"), dim)
                if not len(x):
                    continue
                ids = part.column("vec_id").filter(pa.array(fits)).to_pylist()
                first = sorted((seed_key(i), x[n].tolist()) for n, i in enumerate(ids) if i is not None)[:k]
                row = [[ids], [x.astype("<i4").tobytes()], [None], [None], [None], [None], [[{"key": s, "point": p} for s, p in first]]]
                kinds = [pa.list_(pa.int64()), *[pa.binary()] * 5, pa.list_(pa.struct([("key", pa.string()), ("point", pa.list_(pa.int64()))]))]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=[*_NAMES, "seeds"])

    return run


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((x - y) ** 2).sum(axis=-1)


class Step:
    """What one assignment needs of the centroids: their places, how far each has moved, half the way to its nearest neighbour."""

    def __init__(self, centres: np.ndarray, before: np.ndarray | None = None):
        self.centres = centres
        self.drift = np.sqrt(squared(centres, centres if before is None else before).astype(np.float64)) * (1 + SLACK)
        gaps = np.sqrt(squared(centres[:, None], centres[None]).astype(np.float64)) / 2 * (1 - SLACK)
        np.fill_diagonal(gaps, np.inf)
        self.half = gaps.min(axis=1)
        order = np.argsort(-self.drift, kind="stable")
        self.rest = np.full(len(centres), self.drift[order[0]])  # the largest drift of the others
        self.rest[order[0]] = self.drift[order[1]] if len(order) > 1 else 0.0

    def scan(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid by exact integers, the smaller number on ties, with the two bounds that follow."""
        d = np.stack([squared(x, c) for c in self.centres], axis=1)
        near = d.argmin(axis=1)
        upper = np.sqrt(d[np.arange(len(d)), near].astype(np.float64)) * (1 + SLACK)
        if d.shape[1] == 1:
            return near, upper, np.full(len(d), np.inf)
        second = np.partition(d, 1, axis=1)[:, 1]
        return near, upper, np.sqrt(second.astype(np.float64)) * (1 - SLACK)

    def assign(self, x: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The new state of vectors that have one, and how many of them a full scan decided.

        Bounds are loosened by the drift. A vector stays where its upper bound is below its lower bound or below half
        the way from its centroid to the next, strictly, so that no tie is decided by a bound.
        """
        upper = (upper + self.drift[near]) * (1 + SLACK)
        lower = np.maximum(lower - self.rest[near], 0.0) * (1 - SLACK)
        near = near.copy()
        unsure = np.flatnonzero(upper >= np.maximum(lower, self.half[near]))
        upper[unsure] = np.sqrt(squared(x[unsure], self.centres[near[unsure]]).astype(np.float64)) * (1 + SLACK)
        unsure = unsure[upper[unsure] >= np.maximum(lower[unsure], self.half[near[unsure]])]
        if len(unsure):
            near[unsure], upper[unsure], lower[unsure] = self.scan(x[unsure])
        return near, upper, lower, len(unsure)


def _advance(step: Step, dim: int):
    def run(batches):
        k = len(step.centres)
        for rb in batches:
            for row in rb.to_pylist():
                x = np.frombuffer(row["points"], "<i4").reshape(-1, dim).astype(np.int64)
                if row["cluster"] is None:
                    near, upper, lower = step.scan(x)
                else:
                    near, upper, lower, _ = step.assign(x, np.frombuffer(row["cluster"], "<i2").astype(np.int64), np.frombuffer(row["upper"], "<f8"), np.frombuffer(row["lower"], "<f8"))
                sums = np.zeros((k, dim + 1), np.int64)
                for j in range(k):
                    own = x[near == j]
                    sums[j, 0], sums[j, 1:] = len(own), own.sum(axis=0)
                row |= {"cluster": near.astype("<i2").tobytes(), "upper": upper.astype("<f8").tobytes(), "lower": lower.astype("<f8").tobytes(), "sums": sums.astype("<i8").tobytes()}
                yield pa.RecordBatch.from_arrays([pa.array([row[n]], pa.list_(pa.int64()) if n == "ids" else pa.binary()) for n in _NAMES], names=_NAMES)

    return run


def _totals(k: int, dim: int):
    """One row for each centroid and column of its sums, of all blocks that a task reads."""

    def run(batches):
        total = np.zeros((k, dim + 1), np.int64)
        for rb in batches:
            for raw in rb.column("sums").to_pylist():
                total += np.frombuffer(raw, "<i8").reshape(k, dim + 1)
        at = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(total.ravel(), pa.int64())], names=["j", "c", "n"])

    return run


def moved(centres: np.ndarray, blocks: DataFrame) -> np.ndarray:
    """Each centroid that has vectors at the exact floor of their componentwise mean; the others where they were."""
    k, dim = centres.shape
    sums = blocks.select("sums").mapInArrow(_totals(k, dim), "j int, c int, n long").groupBy("j", "c").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    total = {(r.j, r.c): int(r.n) for r in sums.collect()}  # k * (dim + 1) rows
    out = centres.copy()
    for j in range(k):
        if n := total.get((j, 0), 0):
            out[j] = [total[j, c + 1] // n for c in range(dim)]
    return out


def _members(step: Step, dim: int):
    def run(batches):
        for rb in batches:
            for row in rb.to_pylist():
                x, near = np.frombuffer(row["points"], "<i4").reshape(-1, dim).astype(np.int64), np.frombuffer(row["cluster"], "<i2")
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(near, pa.int32()), pa.array(squared(x, step.centres[near]), pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def clustered(vectors: DataFrame, k: int = CENTRES, rounds: int = ROUNDS, dim: int = DIM) -> DataFrame:
    """One row per vector that takes part: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors of exactly `dim` finite components become integers, floor(1024 * x). Centroids start as the k vectors of
    least sha256 of "3:<vec_id>" (then by components; null ids are clustered but start none). Each of `rounds` rounds
    assigns every vector to its nearest centroid (ties: smaller number) and moves the centroids to the exact floor of
    their vectors' mean; then vectors are assigned once more. Each vector keeps one upper bound (to its centroid) and
    one lower bound (to the second nearest); only vectors that the bounds leave open are scanned, in exact integers, so
    the result is that of plain rounds.

    Vectors and bounds lie in blocks of up to 4,096 in the shared folder; a round is one narrow pass over them that
    writes the next state (then the last is deleted), and one over the blocks' sums: nothing is shuffled but k * 65
    sums a task, and the driver holds k * 65 numbers. Fewer than k vectors give as many centroids; no vector gives an
    empty result. Repeated rows are vectors of their own. Vectors with a null or non-finite component, another number
    of components, or a component of 131,072 or more in magnitude (its squared distance would not fit) do not take
    part. Further columns are ignored.
    """
    spark = vectors.sparkSession
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    blocks = cut(slim.mapInArrow(_pack(dim, k), STATE + ", seeds array<struct<key: string, point: array<long>>>"), "blocks")
    first = blocks.select(F.inline("seeds")).orderBy("key", "point").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centres, before = np.array([r.point for r in first], np.int64), None
    for n in range(rounds + 1):
        after = cut(blocks.select(*_NAMES).mapInArrow(_advance(Step(centres, before), dim), STATE), "blocks")
        discard(blocks)
        blocks = after
        if n < rounds:
            before, centres = centres, moved(centres, blocks)
    members = cut(blocks.select("ids", "points", "cluster").mapInArrow(_members(Step(centres), dim), "vec_id long, cluster int, distance long"), "members")
    discard(blocks)
    sums = {r.cluster: int(r.n) for r in members.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}  # k rows
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    of = F.col("cluster") + 1
    return members.select(
        "vec_id", "cluster", "distance", F.element_at(F.array(*[F.lit(sums.get(j, 0)).cast("long") for j in range(len(centres))]), of).alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"), F.element_at(F.array(*[F.lit(h) for h in hashes]), of).alias("centroid_sha256"),
    )
