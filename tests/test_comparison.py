"""Comparison of recordings against numpy on the same samples."""

from __future__ import annotations

import numpy as np
import pytest

from undula import params as P
from undula.operators import comparison as CM
from undula.sources import pcm

SR, CHUNK, N, HOP = 8000, 4096, 256, 128
PARAMS = P.Params(nfft=N, overlap=0.5)


def table(spark, sounds, sr=SR):
    rows = [(name, 0, k, sr, [float(v) for v in x[k * CHUNK : (k + 1) * CHUNK]]) for name, x in sounds.items() for k in range(-(-len(x) // CHUNK))]
    return spark.createDataFrame(rows, pcm.CHUNKS)


def levels(x):
    x = x.astype(np.float32).astype(float)
    w = np.hanning(N)
    cols = np.array([np.abs(np.fft.rfft(x[k : k + N] * w)) for k in range(0, len(x) - N + 1, HOP)])
    return 20 * np.log10(np.maximum(cols / cols.max(), 1e-12))


def test_offsets_and_differences(spark):
    rng = np.random.default_rng(4)
    burst = lambda n: rng.normal(size=n) * np.repeat(rng.uniform(0.01, 1, -(-n // 500)), 500)[:n]
    x, y, z = burst(20000), burst(12000), burst(9000)
    a = {"late": x[10 * HOP :], "early": y, "short": z, "alone": z}
    b = {"late": x * 0.5 + 0.02 * burst(20000), "early": y[7 * HOP :], "short": z[: N + 5]}
    codecs = spark.createDataFrame([(k, "flac") for k in a], "file string, codec string")
    rows, panels = CM.compare(table(spark, a), table(spark, b), codecs, PARAMS, SR, CHUNK, min_hz=1000.0)
    got = {r.file: r for r in rows.collect()}
    assert set(got) == set(b)
    shown = {}
    for r in panels.collect():
        shown.setdefault((r.file, r.panel), {})[r["col"]] = r.db
    for name, shift in (("late", -10), ("early", 7), ("short", 0)):
        da, db = levels(a[name]), levels(b[name])
        r = got[name]
        assert r.offset_s == pytest.approx(shift * HOP / SR, abs=1e-4)
        da, db = da[max(shift, 0) :], db[max(-shift, 0) :]
        n = min(len(da), len(db))
        if n > 1:
            da, db = da[:n], db[:n]
        d = np.maximum(da, -100) - np.maximum(db, -100)
        inside = d[:, : max(4, int(r.band_hz / (SR / N)))]
        assert [r.median_db, r.mean_abs_db, r.p90_abs_db, r.max_abs_db] == pytest.approx([np.median(inside), np.abs(inside).mean(), np.percentile(np.abs(inside), 90), np.abs(inside).max()], abs=0.02)
        diff = shown[name, "diff"]
        assert sorted(diff) == list(range(len(d))) and np.allclose([diff[k] for k in range(len(d))], d, atol=0.01)
        assert min(shown[name, "a"]) == min(shown[name, "b"]) == 0
    assert got["early"].diff_key == "diff.identical" and got["early"].level == "ok"


def test_rates_are_brought_together(spark):
    t = np.arange(40000) / 16000
    x = sum(np.sin(2 * np.pi * f * t * (1 + 0.1 * t)) for f in (200, 450, 900, 1700, 2600)) * 0.1 + np.random.default_rng(1).normal(size=len(t)) * 1e-5
    codecs = spark.createDataFrame([("s", "mp3")], "file string, codec string")
    low = table(spark, {"s": x[::2]})
    r = CM.compare(low, table(spark, {"s": x}, 16000), codecs, PARAMS, SR, CHUNK, rates=(SR, 16000), min_hz=1000.0)[0].first()
    assert r.offset_s == 0 and abs(r.median_db) < 3
