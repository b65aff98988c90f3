"""Cosine self-join of embeddings with randomised-rotation binary codes."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, join_spread, runs
from .graph import components
from .jaccard_join import _blocks, _dealt

_ROTATION: dict[int, np.ndarray] = {}


def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    if dim not in _ROTATION:
        q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
        _ROTATION[dim] = q * np.sign(np.diag(r))
    return _ROTATION[dim]


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits of the rotated unit vectors and each code's correction factor: its inner product with the vector."""
    turned = unit @ rotation(unit.shape[1])
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(unit.shape[1])


def quantised(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated vectors in one byte a dimension: the bytes, what one step is worth, and the length of the rounding error."""
    step = np.maximum(np.abs(turned).max(axis=1), 1e-300) / 127
    near = np.rint(turned / step[:, None]).astype(np.int8)
    return near, step, np.sqrt(((turned - near * step[:, None]) ** 2).sum(axis=1))


def estimate(bits: np.ndarray, corr: np.ndarray, turned: np.ndarray, lost: np.ndarray, confidence: float) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the inner products of coded vectors (rows) with rotated ones (columns), and their bounds.

    With o the vector, c its code and <c, o> the correction factor, <c, q> / <c, o> estimates <o, q>; its error is
    below confidence * sqrt((1 - <c,o>^2) / <c,o>^2 / (dim - 1)) but for a chance that falls as exp(-confidence^2 / 2).
    Where q is rounded, its error's length `lost` adds at most lost / <c, o>, as c has length 1.
    """
    dim = turned.shape[1]
    signs = (np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(dim))
    guess = (signs @ turned.T.astype(np.float32)) / corr[:, None].astype(np.float32)
    error = confidence * np.sqrt(np.maximum(0, 1 - corr**2) / corr**2 / max(1, dim - 1))
    return guess, error[:, None] + lost[None, :] / corr[:, None] + 1e-5


def plan_bands(n: int, threshold: float, miss: float, bucket: int = 512) -> tuple[int, int]:
    """Bits per band so that a bucket of unrelated vectors has about `bucket`, and bands so that a pair at the threshold is missed by chance `miss`."""
    bits = max(1, math.ceil(math.log2(max(2, n / bucket))))
    hit = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - hit)))


def _vectors(batches):
    for rb in batches:
        ids, key, vec = [], [], []
        for i, v in zip(rb.column("vec_id").to_pylist(), rb.column("v").to_pylist(), strict=True):
            good = None
            if v and None not in v:
                a = np.array(v, np.float64)
                top = np.abs(a).max()
                if np.isfinite(a).all() and top > 0:
                    good = a
            ids.append(i)
            raw = good.tobytes() if good is not None else None
            key.append(hashlib.blake2b(raw, digest_size=16).digest() if raw else None)
            vec.append(raw)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(key, pa.binary()), pa.array(vec, pa.binary())], names=["vec_id", "key", "vec"])


def _unit(raw: list[bytes]) -> np.ndarray:
    a = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    a = a / np.abs(a).max(axis=1, keepdims=True)
    return a / np.sqrt((a * a).sum(axis=1, keepdims=True))


def _code(bits: int, bands: int):
    def run(batches):
        for rb in batches:
            raw, keys, weight = rb.column("vec").to_pylist(), rb.column("key").to_pylist(), rb.column("weight").to_pylist()
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(raw):
                by_dim.setdefault(len(v) // 8, []).append(i)
            for dim, at in by_dim.items():
                unit = _unit([raw[i] for i in at])
                code, corr = codes(unit)
                near, step, lost = quantised(unit @ rotation(dim))
                planes = np.random.default_rng(dim + 1).standard_normal((dim, bits * bands))
                side = (unit @ planes > 0).reshape(len(at), bands, bits)
                number = np.zeros((len(at), bands), np.uint32)
                for j in range(bits):
                    number = number * 2 + side[:, :, j].astype(np.uint32)
                raw_of = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([keys[i] for i in at], pa.binary()), pa.array([weight[i] for i in at], pa.int64()), pa.array([dim] * len(at), pa.int32()),
                        raw_of(unit.astype("<f8")), raw_of(code), pa.array(corr, pa.float64()), raw_of(near), pa.array(step, pa.float64()), pa.array(lost, pa.float64()),
                        raw_of(number), pa.array(number.astype(np.int64).tolist(), pa.list_(pa.int64())),
                    ],
                    names=["key", "weight", "dim", "unit", "code", "corr", "near", "step", "lost", "numbers", "bands"],
                )

    return run


def _stack(column, kind, dim: int = -1) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), dim)


def _maybe(bits, corr, turned, lost, block, two, threshold, confidence):
    """(i, j) of the pairs i < j whose upper bound reaches the threshold, a stretch of rows at a time."""
    m = len(bits)
    for at in range(0, m, 256):
        rows = slice(at, min(at + 256, m))
        guess, error = estimate(bits[rows], corr[rows], turned, lost, confidence)
        maybe = guess + error >= threshold
        maybe &= np.arange(m)[None, :] > np.arange(at, rows.stop)[:, None]
        if two:
            maybe &= block[rows, None] != block[None, :]
        i, j = np.nonzero(maybe)
        yield i + at, j


def _active(threshold: float, confidence: float):
    """The members of a bucket that have a pair whose bound reaches the threshold, from codes and rounded vectors alone."""

    def run(batches):
        for group in runs(batches, ["dim", "band", "number", "g"]):
            m = len(group)
            if m < 2:
                continue
            group = group.iloc[np.argsort(group["key"].to_numpy())]
            turned = _stack(group["near"], np.int8) * group["step"].to_numpy()[:, None]
            found = np.zeros(m, bool)
            bits, corr, lost, block = _stack(group["code"], np.uint8), group["corr"].to_numpy(), group["lost"].to_numpy(), group["block"].to_numpy()
            for i, j in _maybe(bits, corr, turned, lost, block, bool(group["cross"].iloc[0]), threshold, confidence):
                found[i] = True
                found[j] = True
            if found.any():
                part = group[found]
                kinds = {"key": pa.binary(), "dim": pa.int32(), "band": pa.int32(), "number": pa.int64(), "g": pa.int32(), "block": pa.int32(), "cross": pa.bool_()}
                yield pa.RecordBatch.from_arrays([pa.array(part[c].tolist(), k) for c, k in kinds.items()], names=list(kinds))

    return run


def _link(threshold: float, confidence: float):
    """One row per vector of a bucket that has links which no earlier band shows, with a spanning forest of them."""

    def run(batches):
        for group in runs(batches, ["dim", "band", "number", "g"]):
            m = len(group)
            if m < 2:
                continue
            group = group.iloc[np.argsort(group["key"].to_numpy())]
            band = int(group["band"].iloc[0])
            unit, numbers = _stack(group["unit"], np.float64), _stack(group["numbers"], np.uint32)[:, :band]
            block, weight = group["block"].to_numpy(), group["weight"].to_numpy()
            two = bool(group["cross"].iloc[0])
            bits, corr = codes(unit)
            links, root = np.zeros(m, np.int64), np.arange(m)

            def find(x):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for i, j in _maybe(bits, corr, unit @ rotation(unit.shape[1]), np.zeros(m), block, two, threshold, confidence):
                for k in range(0, len(i), 65536):
                    a, b = i[k : k + 65536], j[k : k + 65536]
                    if band:
                        new = ~(numbers[a] == numbers[b]).any(axis=1)
                        a, b = a[new], b[new]
                    sure = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
                    a, b = a[sure], b[sure]
                    np.add.at(links, a, weight[b])
                    np.add.at(links, b, weight[a])
                    for x, y in zip(a.tolist(), b.tolist(), strict=True):
                        x, y = find(x), find(y)
                        if x != y:
                            root[max(x, y)] = min(x, y)
            at = np.flatnonzero(links)
            if len(at):
                keys = group["key"].tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[x] for x in at], pa.binary()), pa.array(links[at], pa.int64()), pa.array([keys[find(x)] for x in at], pa.binary())], names=["key", "links", "root"]
                )

    return run


def linked(vectors: DataFrame, threshold: float = 0.9, miss: float = 1e-5, confidence: float = 5.0, bucket: int = 512, block: int = 1024) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Two vectors are linked when their cosine, in double precision, is at least `threshold`; labels play no part. Equal
    vectors are one class with a weight. Random hyperplanes deal the classes into buckets (a pair at the threshold
    shares none by chance `miss`; the bits grow with the logarithm of the number of classes, so that buckets of
    unrelated vectors keep about `bucket` members). To its buckets a vector goes as its sign code, its correction factor
    and its rotated coordinates in a byte each; every pair's inner product is estimated from one's code and the other's
    rounded coordinates. Only vectors with a pair whose upper confidence bound reaches the threshold go to the bucket
    again, exact, and the cosine is computed. A pair counts in the first band that both share, so that no pair is ever a
    row; buckets are split in blocks of about `block` vectors and every two blocks meet.

    A vector that is null, empty, zero, or has a null or non-finite component links with nothing. Vectors of different
    lengths do not link. Repeated rows each get a row and link with their copies. A null vec_id takes part but names no
    component. An empty table gives an empty result; further columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).mapInArrow(_vectors, "vec_id long, key binary, vec binary")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    classes = rows.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.max("vec").alias("vec"))
    classes = cut(classes, "vector-classes")
    bits, bands = plan_bands(classes.count(), threshold, miss, bucket)
    kind = "key binary, weight long, dim int, unit binary, code binary, corr double, near binary, step double, lost double, numbers binary, bands array<bigint>"
    coded = cut(classes.select("key", "weight", "vec").mapInArrow(_code(bits, bands), kind), "codes")
    order = ["dim", "band", "number", "g"]
    dealt = coded.select("key", "dim", F.posexplode("bands").alias("band", "number"))
    shared = cut(dealt.groupBy("dim", "band", "number").agg(F.count("*").alias("m")).filter("m > 1"), "vector-buckets")
    pairs = F.sum(F.col("m") * F.greatest(F.col("m"), F.lit(1)))
    work = shared.agg(pairs).first()[0] or 0
    members = join_spread(dealt, shared, order[:3], F.col("key")).join(coded.select("key", "code", "corr", "near", "step", "lost"), "key")
    members = _blocks(members, F.col("m") / block, *order[:3]).drop("m", "nb")
    kind = "key binary, dim int, band int, number long, g int, block int, cross boolean"
    active = cut(_dealt(members, work, order, 100_000_000).mapInArrow(_active(threshold, confidence), kind), "vector-pairs")
    work = active.groupBy(*order).agg(F.count("*").alias("m")).agg(pairs).first()[0] or 0
    exact = active.join(coded.select("key", "weight", "unit", "numbers"), "key")
    found = _dealt(exact, work, order, 100_000_000).mapInArrow(_link(threshold, confidence), "key binary, links long, root binary")
    found = cut(found, "vector-links")
    for done in (coded, shared, active):
        discard(done)
    label = components(found.select(F.col("key").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("key"), "label")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    named = classes.select("key", "least", "weight").join(links, "key", "left").join(label, "key", "left").withColumn("label", F.coalesce("label", "key"))
    named = cut(named, "vectors-named")
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = join_spread(named, ids, ["label"], F.col("key")).select("key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = join_spread(rows.select("vec_id", "key", "row"), named, ["key"], F.col("row"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
