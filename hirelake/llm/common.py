"""Helpers shared by the text operators: durable cuts, hashing in numpy, grouped streams."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

_LOCAL_SHARED: dict[str, str] = {}
#: Spark's setting by which a query's shuffle files go when it ends, not when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all
    work is done by one machine (tests). On a cluster without the setting this raises: each executor would write to a
    disk that the others do not see.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        path = _LOCAL_SHARED.setdefault(app, "file://" + tempfile.mkdtemp(prefix="hirelake-"))
    return path.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path object for a path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back, so that a lost executor costs no recomputation upstream.

    The files go at the application's end, or before by `discard`; the shuffles that led to them go once they are written,
    so that the disk holds those of one step and not of all.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    fs, place = _file_system(spark, path)
    fs.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a frame made by `cut` that nothing will read again."""
    path = getattr(df, "_cut_path", None)
    if path:
        fs, place = _file_system(df.sparkSession, path)
        fs.delete(place, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, made longer where df has a column of that name already."""
    held, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in held:
            n += "_"
        held.add(n.lower())
        out.append(n)
    return out


def join_spread(df: DataFrame, small: DataFrame, keys: list[str], spread: Column, how: str = "inner") -> DataFrame:
    """df joined to `small`, which has one row for each key, where one key may hold any share of df's rows.

    df's rows are dealt by the keys and a salt of `spread`; small's row goes once to each salt that occurs with its key,
    no more than there are shuffle partitions.
    """
    salt, n = "_salt", int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(n)).cast("int"))
    parts = df.select(*keys, salt).distinct().join(small, keys)
    return df.join(parts, [*keys, salt], how).drop(salt)


def one_of_each(df: DataFrame, *keys: str) -> DataFrame:
    """Of the rows that share the keys, the one of greatest hash over its columns (maps and variants aside), so that reruns agree."""
    told = [c for c, kind in df.dtypes if c not in keys and "map<" not in kind and "variant" not in kind]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.xxhash64(*told)).alias("best"))
    return best.select(*[c if c in keys else F.col("best").getField(c).alias(c) for c in df.columns])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet")


def fold3(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's decimal text modulo 3; a null id falls in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3, F.lit(0))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


# --- 64-bit hashing of words with array operations -------------------------------------------

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Separators for words of letters only: every ASCII byte that is not a letter.
NOT_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
_P = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_CHUNK = 1 << 20
_POW: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser (xor-shift and multiply) that spreads the low bits."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for base in (_P, pow(_P, -1, 1 << 64)):
            a = np.full(size, _U(base))
            a[0] = _U(1)
            out.append(np.multiply.accumulate(a))
        _POW[:] = out
    return _POW[0][:n], _POW[1][:n]


def _hashes(b: np.ndarray, space: np.ndarray, prefixes: tuple[int, ...] = ()) -> np.ndarray:
    word = ~space[b]
    if not word.any():
        return np.empty(0, np.uint64)
    edge = np.diff(np.concatenate(([False], word, [False])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _powers(len(b))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * power, dtype=np.uint64)))
    out = [mix((total[end] - total[start]) * inverse[start])]
    for n in prefixes:  # the first n bytes of longer words, apart from whole words by a salt
        at = start[end - start > n]
        out.append(mix((total[at + n] - total[at]) * inverse[at] + _U(n)))
    return out[0] if not prefixes else np.concatenate(out)


def word_hashes(text: str | None, space: np.ndarray = _SPACE, prefixes: tuple[int, ...] = ()) -> np.ndarray:
    """One 64-bit hash per word, in order; words are runs of bytes other than `space` (white space), in lower case.

    With `prefixes`, hashes of the words' first so many bytes follow, and the order says nothing.
    """
    return byte_hashes(np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8), space, prefixes)


def byte_hashes(b: np.ndarray, space: np.ndarray = _SPACE, prefixes: tuple[int, ...] = ()) -> np.ndarray:
    """The same for bytes, as they are; long ones are read in stretches that end at white space."""
    if len(b) <= _CHUNK:
        return _hashes(b, space, prefixes)
    out, at = [], 0
    while at < len(b):
        end = min(at + _CHUNK, len(b))
        while end < len(b) and not space[b[end]]:
            gap = np.flatnonzero(space[b[end : end + _CHUNK]])
            end = end + int(gap[0]) if len(gap) else min(end + _CHUNK, len(b))
        out.append(_hashes(b[at:end], space, prefixes))
        at = end
    return np.concatenate(out)


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of k consecutive words; a text of fewer words is one shingle, an empty one none."""
    n = len(words)
    if n == 0:
        return words
    width = min(k, n)
    h = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        h = h * _U(_P) + words[j : n - width + 1 + j]
    return np.unique(mix(h))


def digest(words: np.ndarray) -> bytes:
    """16 bytes that stand for the whole word sequence."""
    n = _U(len(words))
    out = []
    with np.errstate(over="ignore"):
        for salt in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
            total = np.uint64(salt) + n
            for at in range(0, len(words), 1 << 16):
                part = mix(words[at : at + (1 << 16)] ^ _U(salt))
                power = _powers(len(part))[0]
                total = total * _U(_P) + np.sum(part * power, dtype=np.uint64)
            out.append(mix(np.array([total], np.uint64))[0])
    return np.array(out, np.uint64).tobytes()


def slices(batches, rows: int = 256):
    """The same record batches in parts of at most `rows` rows, so that Python objects exist for a few rows at a time."""
    for rb in batches:
        for at in range(0, rb.num_rows, rows):
            yield rb.slice(at, rows)


# --- groups read as a sorted stream -----------------------------------------------------------


def runs(batches, keys: list[str]):
    """Yield one pandas frame per run of equal keys from batches that are sorted by keys; a run may span batches.

    Holds one run at a time, so callers bound the size of a run before they sort.
    """
    import pandas as pd

    held: list[pd.DataFrame] = []
    last = None
    for batch in batches:
        pdf = batch if isinstance(batch, pd.DataFrame) else batch.to_pandas()
        if not len(pdf):
            continue
        change = np.zeros(len(pdf), bool)
        for k in keys:
            v = pdf[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), len(pdf)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = pdf.iloc[a:b]
            key = tuple(part[k].iloc[0] for k in keys)
            if held and key != last:
                yield held[0] if len(held) == 1 else pd.concat(held)
                held = []
            held.append(part)
            last = key
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held)
