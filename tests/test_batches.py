"""Kernels see slices of their Arrow batches, never a whole batch."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from undula.operators import audio as AU
from undula.operators import pairs as PR
from undula.operators import series as SE
from undula.operators import spectrum as SP
from undula.operators.batches import DOUBLES, SLICE, by_slices


def test_a_kernel_sees_slices(spark):
    rows = spark.range(0, 3000, 1, 1).select("id", F.when(F.col("id") % 7 != 0, F.array(F.col("id").cast("double"))).alias("x"))
    seen = by_slices(lambda k, x: [[float(i), len(k), -1.0 if v is None else v[0]] for i, v in zip(k, x)], "array<double>", DOUBLES)
    out = [r.v for r in rows.select("id", seen("id", "x").alias("v")).orderBy("id").collect()]
    assert max(v[1] for v in out) == SLICE
    assert [(v[0], v[2]) for v in out] == [(float(i), float(i) if i % 7 else -1.0) for i in range(3000)]


def sliced(monkeypatch, module, rows=7):
    """``by_slices`` of ``module`` with slices of a few rows; the list of what is used grows by one for each kernel made."""
    made = []

    def small_slices(kernel, returns, kind, **_):
        made.append(returns)
        return by_slices(kernel, returns, kind, rows=rows)

    monkeypatch.setattr(module, "by_slices", small_slices)
    return made


def test_rates_are_made_by_slices(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=16 * 300)
    chunks = spark.createDataFrame([(1, 0, k, x[k * 16 : k * 16 + 16].tolist()) for k in range(300)], "file int, ch int, chunk long, x array<double>").coalesce(1)
    series = lambda: np.concatenate([r.x for r in SE.resampled(chunks, 3, 2, 16, half=4).orderBy("first").collect()])
    whole, made = series(), sliced(monkeypatch, SE)
    assert np.array_equal(series(), whole) and made


def test_a_long_series_is_sent_by_spans(spark):
    x = np.random.default_rng(6).normal(size=4 * 700)
    chunks = spark.createDataFrame([(1, 0, k, x[k * 4 : k * 4 + 4].tolist()) for k in range(700)], "file int, ch int, chunk long, x array<double>")
    rows = chunks.select("file", "ch", F.lit(700).cast("long").alias("n1"), F.col("chunk").alias("row"), F.col("x").alias("re"))
    assert SE._sent(rows, 4, 2).count() == 2 * -(-700 // SE.SPAN)  # two blocks of columns, and no row for each chunk
    signed = np.abs(np.fft.fftfreq(len(x)))
    want = np.fft.ifft(np.where((signed >= 0.1) & (signed <= 0.2), np.fft.fft(x), 0)).real
    out = np.concatenate([r.x for r in SE.band_passed(chunks, 4, 0.1, 0.2, cells=1 << 10).orderBy("chunk").collect()])
    assert np.allclose(out, want, atol=1e-9)


def test_columns_are_compared_by_slices(spark, monkeypatch):
    x = np.abs(np.random.default_rng(7).normal(size=(2, 60, 40)))
    frames = spark.createDataFrame([(f, 0, k, x[f, k].tolist()) for f in range(2) for k in range(60)], "file int, ch int, frame long, x array<float>").coalesce(1)

    def found():
        columns = AU.stft(frames).cache()
        mags = np.array([r.mags for r in columns.orderBy("file", "col").collect()])
        power = np.array([r.power for r in SP.median_columns(columns.select("file", "col", "mags")).orderBy("file").collect()])
        one = columns.select("file", "col", F.transform("mags", lambda v: v.cast("double")).alias("v"))
        lags = PR.align_columns(one, one.withColumn("col", F.col("col") + 3), "file").orderBy("file").collect()
        return mags, power, [r.lag for r in lags]

    whole, made = found(), [sliced(monkeypatch, m, rows=3) for m in (AU, SP, PR)]
    again = found()
    assert all(made) and np.array_equal(whole[0], again[0]) and np.array_equal(whole[1], again[1]) and whole[2] == again[2] == [-3, -3]


def test_tones_of_columns_as_of_rows(spark):
    rng = np.random.default_rng(8)
    mags = rng.uniform(0.5e-3, 1e-3, size=(90, 129))
    mags[:, 5], mags[:, 70] = 10, 0.05
    columns = spark.createDataFrame([("a", k, mags[k].tolist()) for k in range(90)], "file string, col long, mags array<float>")
    rows = columns.select("file", "col", F.posexplode("mags").alias("bin", "mag"))
    tones = [[tuple(r) for r in SP.tonal_peaks(df, 48000, 256).orderBy("rank").collect()] for df in (columns, rows)]
    assert tones[0] == tones[1] and len(tones[0]) > 0
