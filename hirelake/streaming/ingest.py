"""Structured Streaming ingest: micro-batches merged into a snapshot, once each, by batch number."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SnapshotSink:
    """foreachBatch target: the latest row of each key, kept as a log of runs, with a ledger that is written along.

    Batch n writes its own latest rows as one run, and `derive` of them (where given) as one part of the ledger. Runs of
    one size class, a class being `fan` times the one before, are merged once there are `fan` of them, so a row is
    rewritten once a class and what a batch writes follows the batch, not the state; a state of N bytes has some
    fan * log(N) runs, each in as many files as its size asks for. Reading takes the latest row of each key over all
    runs: by the order column, then by batch.

    The list `runs=n` is written last and names the runs and the ledger together, so both appear at once or not at all,
    and `durable` in it, the rows taken in so far, never runs ahead of them. Batch n starts from the list of batch
    n - 1, so a replayed batch overwrites its own files and counts once; the stream's checkpoint commits after the list.
    Folders that no list of the last two batches names are deleted.
    """

    def __init__(self, folder: str, keys: list[str], order: str, fan: int = 4, unit: int = 1 << 14, derive: Callable[[DataFrame], DataFrame] | None = None):
        self.folder, self.keys, self.order, self.fan, self.unit, self.derive = folder, keys, order, fan, unit, derive
        self.last, self.known = None, {}

    def _place(self, spark: SparkSession, name: str):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def _save(self, spark: SparkSession, number: int, now: dict) -> None:
        fs, path = self._place(spark, f"runs={number}")
        out = fs.create(path, True)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        self.known = {n: x for n, x in self.known.items() if n == number - 1} | {number: now}

    def stands(self, spark: SparkSession, number: int) -> dict:
        """The list of a batch: runs and ledger as [name, bytes], rows taken in, bytes written. Kept, or read after a restart."""
        if number < 0:
            return {"runs": [], "ledger": [], "durable": 0, "written": 0}
        if number not in self.known:
            self.known[number] = json.loads("".join(r[0] for r in spark.read.text(f"{self.folder}/runs={number}").collect()))
        return self.known[number]

    def _write(self, spark: SparkSession, rows: DataFrame, name: str) -> list:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        fs, path = self._place(spark, name)
        return [name, fs.getContentSummary(path).getLength()]

    def _read(self, spark: SparkSession, schema, parts: list) -> DataFrame:
        return spark.read.schema(schema).parquet(*[f"{self.folder}/{name}" for name, _ in parts])

    def _latest(self, rows: DataFrame) -> DataFrame:
        best = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in self.keys]), F.struct(self.order, "in_batch")).alias("best"))
        return best.select(*[c if c in self.keys else F.col("best").getField(c).alias(c) for c in rows.columns])

    def _class(self, size: int) -> int:
        n = 0
        while size > self.unit:
            size, n = size / self.fan, n + 1
        return n

    def _merged(self, spark: SparkSession, schema, parts: list, name: str, merge: Callable[[DataFrame], DataFrame]) -> tuple[list, int]:
        """The parts with each full size class turned into one part, and the bytes that this wrote."""
        written, at = 0, 0
        while True:
            by: dict[int, list] = {}
            for p in parts:
                by.setdefault(self._class(p[1]), []).append(p)
            full = next((c for c in sorted(by) if len(by[c]) >= self.fan), None)
            if full is None:
                return parts, written
            new = self._write(spark, merge(self._read(spark, schema, by[full])), f"{name}-{at}")
            parts, written, at = [p for p in parts if p not in by[full]] + [new], written + new[1], at + 1

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = self.stands(spark, number - 1)
        batch = batch.persist()
        try:
            run = self._write(spark, self._latest(batch.withColumn("in_batch", F.lit(number).cast("long"))), f"run={number}")
            schema = batch.withColumn("in_batch", F.lit(0).cast("long")).schema
            runs, written = self._merged(spark, schema, before["runs"] + [run], f"run={number}", self._latest)
            ledger, written = before["ledger"], written + run[1]
            if self.derive is not None:
                derived = self.derive(batch)
                part = self._write(spark, derived, f"ledger={number}")
                ledger, more = self._merged(spark, derived.schema, ledger + [part], f"ledger={number}", lambda df: df)
                written += part[1] + more
            self._save(spark, number, {"runs": runs, "ledger": ledger, "durable": before["durable"] + batch.count(), "written": written})
        finally:
            batch.unpersist()
        self._sweep(spark, number, {n for n, _ in runs + ledger + before["runs"] + before["ledger"]})
        self.last = number

    def _sweep(self, spark: SparkSession, number: int, named: set[str]) -> None:
        fs, root = self._place(spark, "")
        for entry in fs.listStatus(root):
            name = entry.getPath().getName()
            kind, _, n = name.partition("=")
            if (kind in ("run", "ledger") and name not in named) or (kind == "runs" and int(n) < number - 1):
                fs.delete(entry.getPath(), True)

    def state(self, spark: SparkSession, schema) -> DataFrame:
        """The latest row of each key after the last batch."""
        runs = self.stands(spark, self.last)["runs"] if self.last is not None else []
        if not runs:
            return spark.createDataFrame([], schema)
        stored = schema if "in_batch" in schema.fieldNames() else schema.add("in_batch", "long")
        return self._latest(self._read(spark, stored, runs)).drop("in_batch")

    def ledger(self, spark: SparkSession, schema) -> DataFrame:
        """All that `derive` has made of the batches, each once."""
        parts = self.stands(spark, self.last)["ledger"] if self.last is not None else []
        return self._read(spark, schema, parts) if parts else spark.createDataFrame([], schema)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one where that is unset and one machine does all the work."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="hirelake-")
    path = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def ingested(spark: SparkSession, events: DataFrame, files: int = 4, derive: Callable[[DataFrame], DataFrame] | None = None) -> tuple[SnapshotSink, DataFrame]:
    """A sink that has taken in (user_id, event_id, ts, ...) by way of a file stream read two files at a time until it is
    drained, and the last event of each user.
    """
    root = shared_folder(spark)
    events.withColumn("at", F.struct("ts", "event_id")).repartition(files).write.parquet(f"{root}/in")
    sink = SnapshotSink(f"{root}/out", ["user_id"], "at", derive=derive)
    schema = spark.read.parquet(f"{root}/in").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    run = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return sink, sink.state(spark, schema)


def latest_by_stream(spark: SparkSession, events: DataFrame, files: int = 4) -> DataFrame:
    return ingested(spark, events, files)[1]


def daily_quota(events: DataFrame, key: str = "kind", at: str = "ts", late: str = "2 days") -> DataFrame:
    """Counts per key and UTC day over a stream; days close once the watermark passes them."""
    return events.withWatermark(at, late).groupBy(key, F.window(at, "1 day")).agg(F.count("*").alias("used"))
