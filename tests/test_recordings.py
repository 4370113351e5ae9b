"""Queries over the recordings of the tables, against what is known of them."""

from __future__ import annotations

import math

import numpy as np
import pytest

from undula.operators import series as SE
from undula.plans import recordings as R


@pytest.fixture(scope="module")
def sounds(spark, sf):
    found = {}
    for r in sorted(spark.read.parquet(f"{sf}/embeddings.parquet").collect(), key=lambda r: r.vec_id):
        found.setdefault(str(r.label), []).extend(r.embedding)
    return {k: np.array(v, np.float64) for k, v in found.items()}


def plain_filter(x, sections):
    for b0, b1, b2, a1, a2 in sections:
        y, s, r = np.zeros(len(x)), 0.0, 0.0
        for n, v in enumerate(x):
            y[n] = b0 * v + s
            s, r = b1 * v - a1 * y[n] + r, b2 * v - a2 * y[n]
        x = y
    return x


def test_loudness_by_the_definition(spark, sf, sounds):
    got = {r.file: r.lufs_integrated for r in R.loudness_r128(spark, sf).collect()}
    assert got.keys() == sounds.keys()
    lufs = lambda p: -0.691 + 10 * math.log10(p + 1e-30)
    for name, x in sounds.items():
        y = plain_filter(x, SE.k_weighting_sections(4000))
        blocks = [(y[k : k + 1600] ** 2).mean() for k in range(0, len(y) - 1599, 400)]
        loud = [p for p in blocks if lufs(p) > -70]
        gated = [p for p in loud if lufs(p) > lufs(np.mean(loud)) - 10] if loud else []
        assert (got[name] is None and not gated) or abs(got[name] - lufs(np.mean(gated))) <= 0.0501


def plain_versions(sounds):
    names = sorted(sounds, key=int)
    for name, other in zip(names, names[1:]):
        b = 0.5 * sounds[name][R.LAG :]
        n = min(len(b), len(sounds[other]))
        b[:n] += 0.05 * sounds[other][:n]
        yield name, sounds[name], b


def test_null_report_by_the_definition(spark, sf, sounds):
    got = {r.file: r for r in R.null_report(spark, sf).collect()}
    wanted = {name: (a[R.LAG :], b) for name, a, b in plain_versions(sounds) if len(b) >= 0.1 * R.SR}
    assert got.keys() == wanted.keys()
    for name, (x, y) in wanted.items():
        gain = x @ y / (y @ y)
        r = x - gain * y
        assert got[name].offset_samples == R.LAG and abs(got[name].gain_db - 20 * math.log10(gain)) < 2e-3
        assert abs(got[name].residual_db - 20 * math.log10(np.sqrt((r @ r) / (x @ x)))) < 0.011 and abs(got[name].correlation - x @ y / np.sqrt(x @ x * (y @ y))) < 2e-5


def test_residual_explains_the_same_rest(spark, sf, sounds):
    got = {r.file: r for r in R.null_residual(spark, sf).collect()}
    for name, a, b in plain_versions(sounds):
        x = a[R.LAG :]
        r = x - (x @ b / (b @ b)) * b
        assert got[name].offset_samples == R.LAG and abs(got[name].residual_peak_db - 20 * math.log10(np.abs(r).max())) < 0.011
        assert abs(got[name].seconds - len(x) / R.SR) < 0.006


@pytest.mark.parametrize("name", ["impulse_scan", "lowfreq_scan", "wow_flutter", "analyse"])
def test_each_recording_has_a_row(spark, sf, sounds, name):
    rows = R.QUERIES[name](spark, sf).collect()
    last = max(sounds, key=int)  # where the next recording is on the right, the last one has none
    assert {r["file"] for r in rows} == set(sounds) - ({last} if name == "analyse" else set())
