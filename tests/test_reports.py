"""Whole reports on made-up recordings with known answers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from undula import params as P
from undula.operators import reports as RP
from undula.plans import reports as PR
from undula.sources import pcm


def test_slices_of_time_are_exact(spark):
    x = np.arange(1000, dtype=np.float32)
    chunks = spark.createDataFrame([("a", 0, k, 100, [float(v) for v in x[k * 128 : (k + 1) * 128]]) for k in range(8)], pcm.CHUNKS)
    for start, seconds in ((0.0, None), (1.28, 2.0), (0.5, 3.33), (2.0, None), (9.5, 4.0), (20.0, 1.0)):
        got = RP.cut(chunks, 128, F.lit(start), None if seconds is None else F.lit(seconds)).orderBy("chunk").collect()
        want = x[int(start * 100) : None if seconds is None else int(start * 100) + int(seconds * 100)]
        assert [len(r.x) for r in got] == [len(want[k : k + 128]) for k in range(0, len(want), 128)]
        assert np.array_equal(np.concatenate([r.x for r in got] or [[]]).astype(np.float32), want)


def test_channels(spark):
    rows = [("s", c, 0, 100, [float(v), float(w)]) for c, v, w in ((0, 1, 2), (1, 3, 6))] + [("m", 0, 0, 100, [5.0, 7.0])]
    chunks = spark.createDataFrame(rows, pcm.CHUNKS)
    want = {"mix": [2, 4], "mid": [2, 4], "left": [1, 2], "right": [3, 6], "side": [-1, -2]}
    for channel, values in want.items():
        got = {r.file: list(r.x) for r in RP.projected(chunks, channel).collect()}
        assert got == {"s": values, "m": [5, 7]}
    assert RP.projected(chunks, "all").count() == 3
    names = spark.createDataFrame([(2, "stereo"), (6, "5.1(side)"), (8, "7.1"), (6, None), (1, "mono")], "n int, layout string").select(RP.channel_labels(F.col("n"), F.col("layout")).alias("l")).collect()
    assert [r.l[:3] for r in names] == [["Left", "Right"], ["L", "R", "C"], ["L", "R", "C"], ["Channel 1", "Channel 2", "Channel 3"], ["Channel 1"]] and len(names[2].l) == 8


def test_analysis_keeps_channels_and_slice(spark):
    got = {(r.file, r.ch): (r.columns, r.top_db) for r in PR.analyse(spark, "").collect()}
    assert set(got) == {("cut", 0), ("cut", 1), ("full", 0)} and {c for c, _ in got.values()} == {(16000 - 512) // 256 + 1}
    assert max(got["cut", 0][1], got["cut", 1][1]) == 0.0 == got["full", 0][1]


def test_band_report(spark):
    got = {r.file: r for r in PR.band_report(spark, "").collect()}
    assert got["cut"].pattern == "constant" and 2300 < got["cut"].edge_hz < 2800 and got["cut"].verdict_key == "band.transcode"


def test_scan_computes_only_what_is_not_stored(spark):
    r = PR.scan_folder(spark, "").first()
    assert (r.files, r.computed, r.cached, r.errors, r.warnings) == (2, 1, 1, 0, 1)


def test_a_scan_takes_as_much_of_long_recordings_as_of_short_ones(spark, monkeypatch):
    lengths = {"a": 16000, "b": 20000, "c": 64000}
    chunks = spark.createDataFrame([(f, 0, k, 8000, [float(v) for v in range(k * 4096, min((k + 1) * 4096, n))]) for f, n in lengths.items() for k in range(-(-n // 4096))], pcm.CHUNKS)
    info = spark.createDataFrame([(f, f, "mp3", 8000, 1, n / 8000, n) for f, n in lengths.items()], PR.INFO)
    taken, transform = [], RP.AU.stft
    monkeypatch.setattr(RP.AU, "stft", lambda frames, *rest: taken.append(frames.select("file", "frame", F.col("x")[0].alias("first"))) or transform(frames, *rest))
    assert RP.quickcheck(chunks, info, 8000, 4096, seconds=2.0, **PR.EDGE).count() == 3
    got = {(r.file.split(RP._PART)[0], r.frame): int(r.first) for r in taken[0].collect()}
    # Two seconds of the middle: six frames, whatever the length.
    assert len(taken) == 1 and got == {(f, k): (n - 16000) // 2 + k * 2048 for f, n in lengths.items() for k in range(6)}


def test_versions_are_aligned(spark):
    r = PR.null_report(spark, "").first()
    assert r.offset_samples == 800 and r.correlation > 0.9 and r.residual_db < -3


def test_residual_is_what_was_taken_out(spark):
    a, b = PR.versions(spark)
    sound, row = RP.residual(a, b, P.Params(), PR.SR, PR.CHUNK, gain_db=0.0)
    x = np.concatenate([r.x for r in sound.orderBy("chunk").collect()])
    at = set((np.flatnonzero(np.abs(x) > 0.3) / PR.SR).round(1).tolist())
    assert row.first().seconds == round(len(x) / PR.SR, 2) and at == {0.9, 1.9, 3.4}
