"""Spectra as columns of arrays: medians, pools and band analysis, each against its form with a row for each bin."""

from __future__ import annotations

import numpy as np
import pytest

from undula.operators import frames as FR
from undula.operators import spectrum as SP


@pytest.mark.parametrize("most", [100_000, 20])
def test_medians_of_columns(spark, most):
    rng = np.random.default_rng(5)
    mags = {(f, c): rng.uniform(0, 1, 150).astype(np.float32) for f, n in (("a", 41), ("b", 12)) for c in range(n)}
    table = spark.createDataFrame([(f, c, v.tolist()) for (f, c), v in mags.items()], "file string, col long, mags array<float>")
    got = {r.file: r.power for r in SP.median_columns(table, most=most).collect()}
    for f in "ab":
        want = np.median(np.array([v.astype(float) ** 2 for (g, _), v in mags.items() if g == f]), axis=0)
        assert np.allclose(got[f], want, rtol=1e-12)


def test_pooled_columns(spark):
    mags = np.random.default_rng(6).uniform(0, 1, (450, 70)).astype(np.float32)
    table = spark.createDataFrame([(f, c, mags[c].tolist()) for f, n in (("a", 450), ("b", 12)) for c in range(n)], "file string, col long, mags array<float>")
    got = {(r.file, r["col"], k): v for r in SP.pooled_columns(table, 100).collect() for k, v in enumerate(r.mags)}
    want = {(r.file, r["col"], r.bin): r.mag for r in FR.max_pool(FR.bins_of(table), 100).collect()}
    assert got == want


def test_band_analysis_of_columns_and_of_rows(spark):
    rng = np.random.default_rng(8)
    shape = np.where(np.arange(257) < 120, 1.0, 1e-5)
    table = spark.createDataFrame([(f, c, (rng.uniform(0.1, 1, 257) * (shape if f == "cut" else 1)).astype(np.float32).tolist()) for f in ("cut", "full") for c in range(90)], "file string, col long, mags array<float>")
    codecs = spark.createDataFrame([("cut", "flac")], "file string, codec string")
    one, other = ({r.file: r for r in SP.band_analysis(t, codecs, 8000, 512, min_hz=1000.0).collect()} for t in (table, FR.bins_of(table)))
    assert one == other and one["cut"].verdict_key == "band.transcode" and one["cut"].blocks == 3
