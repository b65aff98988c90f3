"""Write batches by count or age against plain Python, across restarts; the snapshot's log of runs."""

import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hirelake.session import ship
from hirelake.streaming import batching
from hirelake.streaming.ingest import SnapshotSink


def plain_batches(rows, most, seconds):
    out = {}
    for key in {r[0] for r in rows}:
        held, opened, number, durable = [], None, 0, 0
        for us, i in sorted((us, i) for k, i, us in rows if k == key):
            opened = us if opened is None else opened
            held.append(i)
            if len(held) >= most or us - opened >= seconds * 1_000_000:
                durable += len(held)
                out[key, number] = ("full" if len(held) >= most else "stale", tuple(held), durable)
                held, opened, number = [], us, number + 1
        if held:
            out[key, number] = ("end", tuple(held), durable + len(held))
    return out


def made(n=240, seed=3):
    """Bursts and pauses of three sources, one of which holds most rows; ties of time; parts of a millisecond."""
    rng = random.Random(seed)
    rows, at = [], 1_700_000_000_000_000
    for i in range(n):
        at += rng.choice([0, 137, 900_001, 5_000_000, 61_000_000 if i % 40 == 0 else 2_000_000])
        rows.append((rng.choice("aaaabc"), i, at))
    return rows


def table(spark, rows):
    return ship(spark).createDataFrame(rows, "k string, id long, us long").select("k", "id", F.timestamp_micros("us").alias("ts"))


def found(df):
    rows = df.collect()
    got = {(r.key, r.number): (r.reason, tuple(r.ids), r.durable) for r in rows}
    assert len(got) == len(rows)
    return got


def test_batches_close_by_count_or_age(spark):
    rows = made()
    got = found(batching.write_batches(table(spark, rows), F.col("k"), most=10, seconds=30))
    assert got == plain_batches(rows, 10, 30)
    assert {r for r, _, _ in got.values()} == {"full", "stale", "end"}
    assert batching.write_batches(table(spark, []), F.col("k")).collect() == []


def test_batches_survive_a_restart(spark, tmp_path):
    """The stream stops after some files and goes on from its checkpoint: what was held is still held, nothing counts twice."""
    rows = made(seed=8)
    folder, span = batching.feed(ship(spark), table(spark, rows).select(F.col("k").alias("key"), "id", "ts"), slices=4)
    files = sorted((p for p in Path(folder.removeprefix("file://").removeprefix("file:")).glob("*.parquet")), key=lambda p: p.stat().st_mtime_ns)
    (tmp_path / "in").mkdir()
    for part in (files[: len(files) // 2], [], files[len(files) // 2 :]):
        for p in part:
            shutil.copy2(p, tmp_path / "in" / p.name)
        batching.drain(spark, f"file://{tmp_path}/in", f"file://{tmp_path}", span + 1_000_000, 10, 30)
    assert found(spark.read.schema(batching.OUT).parquet(f"file://{tmp_path}/out")) == plain_batches(rows, 10, 30)


def test_triggers_follow_the_rows_not_the_files(spark):
    """A table of many partitions becomes as few files as its rows ask for, and a slice of many rows is parted."""
    rows = table(spark, made()).repartition(16).select(F.col("k").alias("key"), "id", "ts")
    folder, span = batching.feed(ship(spark), rows, slices=4)
    count = lambda f: len(list(Path(f.removeprefix("file://").removeprefix("file:")).glob("*.parquet")))
    assert count(folder) == 5
    held, batching.SLICE = batching.SLICE, 40
    try:
        parted, shorter = batching.feed(ship(spark), rows, slices=4)
    finally:
        batching.SLICE = held
    assert count(parted) == 7 and shorter < span


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, v long")


def test_snapshot_replays_and_restarts(spark, tmp_path):
    counts = lambda df: df.agg(F.count("*").alias("n"))
    sink = SnapshotSink(f"file://{tmp_path}/state", ["k"], "v", derive=counts)
    batches = [[(k, 0) for k in range(20)], [(3, 5), (4, 1)], [(3, 4), (30, 9)], [(7, 7)]]
    for n, rows in enumerate(batches):
        sink(frame(spark, rows), n)
        if n == 2:
            sink(frame(spark, rows), n)  # replayed
    want = {k: 0 for k in range(20)} | {3: 5, 4: 1, 30: 9, 7: 7}
    schema = frame(spark, []).schema
    assert {r.k: r.v for r in sink.state(spark, schema).collect()} == want
    assert sum(r.n for r in sink.ledger(spark, "n long").collect()) == 25 == sink.stands(spark, 3)["durable"]
    assert len([p for p in (tmp_path / "state").iterdir() if p.name.startswith("runs=")]) == 2
    again = SnapshotSink(f"file://{tmp_path}/state", ["k"], "v", derive=counts)  # restarted
    again(frame(spark, [(1, 1), (1, 1), (3, 5)]), 4)
    assert {r.k: r.v for r in again.state(spark, frame(spark, []).schema).collect()} == want | {1: 1}
    assert sum(r.n for r in again.ledger(spark, "n long").collect()) == 28


def test_snapshot_ties_go_to_the_later_batch(spark, tmp_path):
    rows = lambda v: spark.createDataFrame([(1, 7, v)], "k long, at long, v string")
    sink = SnapshotSink(f"file://{tmp_path}/state", ["k"], "at")
    for n, v in enumerate("zab"):
        sink(rows(v), n)
    assert sink.state(spark, rows("").schema).first().v == "b"


@pytest.mark.parametrize("steps", [14])
def test_what_a_batch_writes_follows_the_batch(spark, tmp_path, steps):
    """Many small batches on a large state: the large run stays as it is, the runs stay few."""
    sink = SnapshotSink(f"file://{tmp_path}/state", ["k"], "v", unit=2048)
    sink(spark.range(200_000).select(F.col("id").alias("k"), F.pmod(F.xxhash64("id"), F.lit(2**61)).alias("v")), 0)
    large = sink.stands(spark, 0)["runs"]
    written = []
    for n in range(1, steps + 1):
        sink(spark.range(40).select((F.col("id") + n * 13).alias("k"), F.lit(2**62 + n).alias("v")), n)
        written.append(sink.stands(spark, n)["written"])
    last = sink.stands(spark, steps)
    assert large[0] in last["runs"] and len(last["runs"]) < 12
    assert max(written) < large[0][1] / 10
    got = {r.k: r.v for r in sink.state(spark, spark.range(1).selectExpr("id AS k", "id AS v").schema).filter("k < 400").collect()}
    assert all(got[k] == 2**62 + min(steps, k // 13) for k in range(13, 13 * steps + 40))
