"""Streams with stops, replays and rows out of order."""

from __future__ import annotations

import random
import shutil
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula.streaming import framed as FD
from undula.streaming import twins as ST
from undula.streaming import upserts as UP

LOG = "root string, path string, level string, cached boolean, error string"
COUNTS = "root string, total long, done long, warnings long, computed long, cached long, errors long, state string"


def batch(spark, folder, name, rows, schema=LOG):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def read(spark, folder, schema=LOG):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def test_stop_restart_and_replay(spark, tmp_path):
    log, out = tmp_path / "log", str(tmp_path / "out")
    totals = spark.createDataFrame([("r", 5), (None, 1)], "root string, total long")

    def run():
        UP.upsert(UP.progress(read(spark, log), totals, "root"), out, ["root"], mode="update").awaitTermination()
        return {r.root: r[1:] for r in UP.current(spark, out, ["root"], COUNTS).collect()}

    assert UP.current(spark, out, ["root"], COUNTS).count() == 0
    batch(spark, log, "a", [("r", "1", "ok", True, None), ("r", "2", "warn", False, None)])
    assert run() == {"r": (5, 2, 1, 1, 1, 0, "running")}
    batch(spark, log, "b", [("r", "3", "warn", True, None), (None, "1", None, False, "x")])
    batch(spark, log, "c", [("r", "4", None, False, "x"), ("r", "5", "ok", False, None)])
    done = {"r": (5, 5, 2, 2, 2, 1, "done"), None: (1, 1, 0, 0, 0, 1, "done")}
    assert run() == done == run()
    numbers = {r.batch for r in UP.history(spark, out, COUNTS).collect()}
    # all input once more under the same batch numbers, as after a crash before any commit
    shutil.rmtree(f"{out}/state")
    assert run() == done and {r.batch for r in UP.history(spark, out, COUNTS).collect()} <= numbers | {0, 1, 2}


def test_upsert_takes_the_latest(spark, tmp_path):
    log, out = tmp_path / "log", str(tmp_path / "out")
    schema = "path string, seen long, level string"

    def run():
        UP.upsert(read(spark, log, schema), out, ["path"], order=F.col("seen")).awaitTermination()
        return sorted(tuple(r) for r in UP.current(spark, out, ["path"], schema).collect())

    batch(spark, log, "a", [("p", 2, "ok"), ("p", 3, "warn"), ("q", 1, "ok"), ("q", 1, "ok")], schema)
    assert run() == [("p", 3, "warn"), ("q", 1, "ok")]
    batch(spark, log, "b", [("p", 4, "ok"), ("s", 1, None)], schema)
    assert run() == [("p", 4, "ok"), ("q", 1, "ok"), ("s", 1, None)]
    moved = UP.compacted(spark, out, ["path"], schema, str(tmp_path / "new"))
    assert sorted(tuple(r) for r in UP.current(spark, moved, ["path"], schema).collect()) == run()


def test_done_counts(spark):
    rows = [("a", k) for k in (5, 70_000, 1, 200_000)] + [(None, 3)]
    got = UP.done_counts(spark.createDataFrame(rows, "root string, at long"), "root", "at", span=F.floor(F.col("at") / 65_536)).collect()
    assert {(r.root, r["at"]): r.done for r in got} == {("a", 1): 1, ("a", 5): 2, ("a", 70_000): 3, ("a", 200_000): 4, (None, 3): 1}


@pytest.mark.parametrize(("size", "hop"), [(4, 3), (3, 5), (5, 5)])
def test_frames_of_a_stream(spark, tmp_path, size, hop):
    """Four files in turn, rows mixed up within the delay of the watermark; one series too short, one with nulls."""
    rng, start, folder = random.Random(7), datetime(2024, 1, 1), tmp_path / "in"
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    rows, k = [], 0
    for name, n in (("a", 57), ("b", 2), ("c", 20)):
        for i in range(n):
            k += 1
            rows.append((k, start + timedelta(minutes=7 * (i // 2)), 1, name, None if name == "c" and i % 6 == 0 else float(i), None))
    rows.sort(key=lambda r: (r[1] + timedelta(minutes=rng.randrange(40)), rng.random()))
    for part in range(4):
        batch(spark, folder, f"{part}", rows[part * len(rows) // 4 : (part + 1) * len(rows) // 4], schema)
    batch(spark, folder, "z", [(None, start + timedelta(days=30), None, "end", None, None)], schema)
    before = spark.conf.get(FD.STORE)
    spark.conf.set(FD.STORE, FD.ROCKS)
    try:
        stream = read(spark, folder, schema).withWatermark("ts", "2 hours")
        got = {(r.event_type, r.frame): list(r.x) for r in ST.collected(FD.series_frames(stream, "event_type", size, hop, span="30 minutes"), ["event_type", "frame"], "append").collect()}
    finally:
        spark.conf.set(FD.STORE, before)
    want = {}
    for name in "abc":
        x = [r[4] for r in sorted((r for r in rows if r[3] == name and r[4] is not None), key=lambda r: (r[1], r[0]))]
        for f in range(max(0, (len(x) - size) // hop + 1)):
            want[name, f] = x[f * hop : f * hop + size]
        if len(x) < size:
            want[name, 0] = list(np.zeros(size))
    assert got == want
