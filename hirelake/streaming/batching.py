"""Write batches that close by count or by age, kept as keyed state with timers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .ingest import shared_folder

MOST_ROWS, MOST_SECONDS = 100, 60
#: Rows of a slice of time at most, unless its microseconds hold more, and rows of a file.
SLICE, FILE = 8_000_000, 1_000_000
OUT = "key string, number long, reason string, ids array<long>, opened long, closed long, durable long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class CountOrAge(StatefulProcessor):
    """Postings of one source in order of time, written when `most` are held or the batch has been open for `seconds`.

    A batch opens when the one before it is written (the first: with its first posting), and its age is looked at when a
    posting arrives, so an idle source holds its batch open. A row with `last` set says that the source has ended: what
    is held goes out as it is. `durable` counts the postings written so far, this batch included; a source may record
    its position up to there and no further.

    Rows wait in state until the watermark has passed them, so those of one micro-batch or several are taken in order
    of time and id however they arrive. State of a source: the rows of one watermark delay, packed by Arrow batches, and
    one open batch.
    """

    def __init__(self, most: int = MOST_ROWS, seconds: int = MOST_SECONDS):
        self.most, self.age = most, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "packed binary")
        self.open = handle.getValueState("open", "opened long, held binary, number long, durable long, seen long")
        self.ended = handle.getValueState("ended", "until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new, until = [], 0
        for df in rows:
            last = df["last"].to_numpy(bool)
            if last.any():
                self.ended.update((int(-(-df["us"].to_numpy()[last] // 1000).max()),))
                until = max(until, int(df["until"].to_numpy()[last].max()))
            if not last.all():
                packed = df.loc[~last, ["us", "id"]].to_numpy(np.int64)
                new.append((packed.tobytes(),))
                until = max(until, int(-(-packed[:, 0].max() // 1000)))
        if new:
            self.waiting.appendList(new)
        self.handle.registerTimer(until)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        packed = b"".join(bytes(r[0]) for r in self.waiting.get()) if self.waiting.exists() else b""
        rows = np.frombuffer(packed, np.int64).reshape(-1, 2)
        is_due = -(-rows[:, 0] // 1000) <= now
        due, later = rows[is_due], rows[~is_due]
        if len(due):
            self.waiting.clear()
            if len(later):
                self.waiting.put([(later.tobytes(),)])
        opened, held, number, durable, seen = self.open.get() if self.open.exists() else (None, b"", 0, 0, 0)
        held = np.frombuffer(bytes(held), np.int64)
        due = due[np.lexsort((due[:, 1], due[:, 0]))]
        us, ids, out, at = due[:, 0], due[:, 1], [], 0

        def write(reason: str, closed: int) -> None:
            nonlocal held, opened, number, durable
            durable += len(held)
            out.append((key[0], number, reason, held, opened, closed, durable))
            held, opened, number = held[:0], closed, number + 1

        while at < len(us):
            opened = int(us[at]) if opened is None else opened
            # the posting that fills the batch, or the first that finds it too old, closes it
            end = 1 + min(at + self.most - len(held) - 1, max(at, int(np.searchsorted(us, opened + self.age))))
            held = np.concatenate([held, ids[at:end]])
            if end <= len(us):
                write("full" if len(held) >= self.most else "stale", int(us[end - 1]))
            at = end
        seen = int(us[-1]) if len(us) else seen
        if len(held) and not len(later) and self.ended.exists():
            write("end", seen)
        if opened is not None:
            self.open.update((opened, held.tobytes(), number, durable, seen))
        for n in range(0, len(out), 4096):
            yield pd.DataFrame(out[n : n + 4096], columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def batches(stream: DataFrame, delay: str, most: int = MOST_ROWS, seconds: int = MOST_SECONDS) -> DataFrame:
    """The write batches of a stream of (key string, id long, ts timestamp, us long, last boolean, until long); see `CountOrAge`.

    ts is the event time in microseconds as `us` has it; `until` is read of `last` rows alone: the millisecond from which
    the watermark says that the source's rows have all arrived.
    """
    whole = stream.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("id", "until")})  # else pandas makes them floats
    return whole.withWatermark("ts", delay).groupBy("key").transformWithStateInPandas(CountOrAge(most, seconds), OUT, "Append", "EventTime")


def with_ends(rows: DataFrame, last_us: int, delay_us: int) -> DataFrame:
    """A row for each key that ends its source, late enough to push the watermark past all others."""
    at = last_us + 2 * delay_us
    return rows.select("key").distinct().select("key", F.lit(None).cast("long").alias("id"), F.timestamp_micros(F.lit(at)).alias("ts"), F.lit(at).cast("long").alias("us"), F.lit(True).alias("last"), F.lit((at - delay_us) // 1000 - 1).cast("long").alias("until"))


def feed(spark: SparkSession, rows: DataFrame, slices: int = 4) -> tuple[str, int]:
    """Write (key, id, ts) as a folder of files in order of time, closed by the sources' ends. Returns the folder, and the microseconds that one slice spans (0: no row).

    Each slice is one write, so that files are newer in order of time; a watermark delay of one slice and a second then
    never calls a row late, in whatever order the files of a slice are read. Slices are `slices`, or more where one would
    pass `SLICE` rows, so what waits of a source is bounded, and files are as few as hold `FILE` rows, as each few of them
    are a trigger.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = rows.select("key", F.col("id").cast("long").alias("id"), F.col("ts").cast("timestamp").alias("ts"), us.alias("us"), F.lit(False).alias("last"), F.lit(None).cast("long").alias("until"))
    low, high, n_rows = rows.agg(F.min("us"), F.max("us"), F.count("*")).first()
    folder = f"{shared_folder(spark)}/in"
    if low is None:
        return folder, 0
    slices = max(slices, -(-n_rows // SLICE))
    span = -(-(high - low + 1) // slices)
    for n in range(slices):
        part = rows.filter((F.col("us") >= low + n * span) & (F.col("us") < low + (n + 1) * span))
        part.repartition(-(-n_rows // slices // FILE) or 1).write.mode("append").parquet(folder)
    with_ends(rows, high, span + 1_000_000).coalesce(1).write.mode("append").parquet(folder)
    return folder, span


def drain(spark: SparkSession, folder: str, root: str, delay_us: int, most: int, seconds: int, keys: int | None = None) -> None:
    """Read what is new in the folder, two files a trigger, and append the batches that close to `root`/out.

    Every trigger commits each partition's state, so where the number of keys is given, a new query has no more than four
    partitions a key.
    """
    provider, parts = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"
    before, n_parts = spark.conf.get(provider, None), spark.conf.get(parts)
    spark.conf.set(provider, ROCKS)  # timers and lists need it; the query keeps the settings it starts with
    if keys:
        spark.conf.set(parts, min(int(n_parts), 4 * keys))
    try:
        stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 2).parquet(folder)
        out = batches(stream, f"{delay_us} microseconds", most, seconds)
        run = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)
        spark.conf.set(parts, n_parts)
    run.awaitTermination()


def write_batches(rows: DataFrame, key: Column, most: int = MOST_ROWS, seconds: int = MOST_SECONDS, slices: int = 4) -> DataFrame:
    """The write batches of a table of (id, ts), by way of a stream over it until it is drained."""
    spark = rows.sparkSession
    folder, span = feed(spark, rows.select(key.cast("string").alias("key"), "id", "ts"), slices)
    if not span:
        return spark.createDataFrame([], OUT)
    root = shared_folder(spark)
    ends = spark.read.parquet(folder).filter("last").count()
    drain(spark, folder, root, span + 1_000_000, most, seconds, ends)
    return spark.read.schema(OUT).parquet(f"{root}/out")
