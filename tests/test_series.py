"""Chunked series against plain numpy on whole arrays."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula.operators import series as S

SCHEMA = "file string, ch int, chunk long, x array<double>"


def series(seed=0, sizes=(("a", 500), ("b", 64), ("c", 7), ("d", 129))):
    rng = np.random.default_rng(seed)
    return {(name, ch): rng.normal(0, 1, n) for name, n in sizes for ch in (0, 1)}


def chunks(spark, found, size):
    rows = [(f, ch, k // size, x[k : k + size].tolist()) for (f, ch), x in found.items() for k in range(0, len(x), size)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def joined(df, name="x", order="chunk"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r[order]):
        out.setdefault((r["file"], r["ch"]), []).append(np.asarray(r[name], float))
    return {k: np.concatenate(v) for k, v in out.items()}


def close(got, want, tol=1e-9):
    assert got.keys() == want.keys()
    for k in want:
        assert len(got[k]) == len(want[k]), k
        np.testing.assert_allclose(got[k], want[k], atol=tol)


def test_rechunked_and_chunked(spark):
    found = series()
    pieces = S.as_pieces(chunks(spark, found, 32), 32)
    for size in (7, 32, 50, 1000):
        close(joined(S.rechunked(pieces, size)), found)
        assert max(map(len, (r["x"] for r in S.rechunked(pieces, size).collect()))) <= size
    samples = pieces.select("file", "ch", F.posexplode("x").alias("k", "x"), "first").select("file", "ch", (F.col("first") + F.col("k")).alias("pos"), "x")
    close(joined(S.chunked(samples, 11)), found)


def plain_resampled(x, up, down, half=8):
    wide = max(up, down)
    edge = half * wide
    out = []
    for m in range(-(-len(x) * up // down)):
        n = m * down - np.arange(len(x)) * up
        h = np.where(np.abs(n) < edge, min(1, up / down) * np.sinc(n / wide) * (0.5 + 0.5 * np.cos(np.pi * n / edge)), 0)
        out.append(h @ x)
    return np.array(out)


@pytest.mark.parametrize("up,down", [(2, 3), (3, 2), (1, 2), (147, 160), (4, 2), (5, 5)])
def test_resampled_does_not_depend_on_chunks(spark, up, down):
    found = series()
    common = math.gcd(up, down)
    want = {k: plain_resampled(x, up // common, down // common) for k, x in found.items()}
    for size in (32, 57):
        close(joined(S.resampled(chunks(spark, found, size), up, down, size), order="first"), want)
    close(joined(S.to_rate(chunks(spark, found, 32), down, up, 32)), want if common == 1 or up != down else found)


def test_resampled_keeps_a_tone(spark):
    x = np.sin(2 * np.pi * 0.05 * np.arange(4000))
    got = joined(S.resampled(chunks(spark, {("t", 0): x}, 500), 3, 2, 500), order="first")["t", 0]
    want = np.sin(2 * np.pi * 0.05 * 2 / 3 * np.arange(6000))
    assert np.abs(got - want)[100:-100].max() < 2e-3


def test_resampled_refuses_filters_beyond_a_chunk(spark):
    with pytest.raises(ValueError):
        S.resampled(chunks(spark, series(), 8), 1, 4, 8)


@pytest.mark.parametrize("size,cells", [(16, 1 << 20), (16, 40), (50, 120)])
def test_whole_spectrum_and_back(spark, size, cells):
    found = {k: v for k, v in series().items() if k[1] == 0}
    c = chunks(spark, found, size)
    block = S.columns_each(c, size, cells)
    spectrum = S.whole_spectrum(c, size, block=block, cells=cells)
    bins = {}
    for r in S.bins_of_spectrum(spectrum).collect():
        bins.setdefault((r["file"], r["ch"]), {})[r["bin"]] = complex(r["re"], r["im"])
    padded = {k: np.pad(v, (0, -len(v) % size)) for k, v in found.items()}
    for k, v in padded.items():
        assert sorted(bins[k]) == list(range(len(v)))
        np.testing.assert_allclose([bins[k][i] for i in range(len(v))], np.fft.fft(v), atol=1e-8)
    back = S.whole_series(spectrum, size, block=block, cells=cells)
    close(joined(back, "re"), padded)
    assert max(np.abs(v).max() for v in joined(back, "im").values()) < 1e-9


def test_band_analytic_and_unwrapped(spark):
    rng = np.random.default_rng(3)
    t = np.arange(960)
    x = np.cos(2 * np.pi * (0.11 * t + 0.5 * np.sin(2 * np.pi * t / 300))) + 0.1 * rng.normal(0, 1, 960)
    c = chunks(spark, {("t", 0): x}, 48)
    spectrum, f = np.fft.fft(x), np.fft.fftfreq(960)
    band = np.where((np.abs(f) >= 0.08) & (np.abs(f) <= 0.14), spectrum, 0)
    close(joined(S.band_passed(c, 48, 0.08, 0.14)), {("t", 0): np.fft.ifft(band).real})
    signal = S.analytic(c, 48, 0.08, 0.14)
    want = np.fft.ifft(np.where(f > 0, 2 * band, 0))
    close(joined(signal, "re"), {("t", 0): want.real})
    close(joined(signal, "im"), {("t", 0): want.imag})
    close(joined(S.unwrapped_phase(signal)), {("t", 0): np.unwrap(np.angle(want))})
    whole = S.analytic(c, 48)
    weight = np.where(f > 0, 2.0, 0.0)
    weight[[0, 480]] = 1
    close(joined(whole, "im"), {("t", 0): np.fft.ifft(spectrum * weight).imag})


def test_section_correlations(spark):
    a, b = series(1), series(2, (("a", 480), ("b", 70), ("d", 300)))
    for section, most in ((32, 40), (64, 17), (512, 100)):
        got = {}
        for r in S.section_correlations(chunks(spark, a, 25), chunks(spark, b, 25), 25, most, section=section).collect():
            got.setdefault((r["file"], r["ch"]), {})[r["lag"]] = r["product"]
        assert got.keys() == {k for k in b if k in a}
        for k, products in got.items():
            for lag in range(-most, most + 1):
                want = sum(a[k][p + lag] * b[k][p] for p in range(len(b[k])) if 0 <= p + lag < len(a[k]))
                assert abs(products.get(lag, 0.0) - want) < 1e-8


def test_strongest_lags(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(5, 1, 900)
    lags = S.strongest_lags(chunks(spark, {("t", 0): x, ("u", 0): x}, 40), chunks(spark, {("t", 0): -x[37:], ("u", 0): np.concatenate([np.full(60, 5.0), x])}, 40), 40, 80, section=100)
    assert {(r["file"], r["lag"]) for r in lags.collect()} == {("t", 37), ("u", -60)}


def plain_filter(x, sections):
    for b0, b1, b2, a1, a2 in sections:
        y = np.zeros(len(x))
        for n in range(len(x)):
            y[n] = b0 * x[n] + sum(b * x[n - k] - a * y[n - k] for k, b, a in ((1, b1, a1), (2, b2, a2)) if n >= k)
        x = y
    return x


@pytest.mark.parametrize("size,span", [(32, 4096), (57, 3), (200, 2), (3, 4)])
def test_recursive_filter(spark, size, span):
    found = series()
    sections = [(0.2, 0.3, 0.1, -1.2, 0.5), (1.0, -2.0, 1.0, -1.97, 0.9701)]
    close(joined(S.recursive_filter(chunks(spark, found, size), sections, size, span=span)), {k: plain_filter(x, sections) for k, x in found.items()})


def test_weighting_is_the_published_one_at_48_khz():
    # The published sections at 48 kHz.
    shelf = (1.53512485958697, -2.69169618940638, 1.19839281085285, -1.69065929318241, 0.73248077421585)
    high = (1.0, -2.0, 1.0, -1.99004745483398, 0.99007225036621)
    got = S.k_weighting_sections(48000)
    np.testing.assert_allclose(got[0], shelf, atol=1e-7)
    np.testing.assert_allclose(got[1], high, atol=1e-7)


def test_short_powers(spark):
    found = series(4, (("a", 500),))
    got = {r["frame"]: r["p"] for r in S.short_powers(chunks(spark, found, 30), 100, 30, step=0.2, steps=4).collect()}
    assert sorted(got) == list(range((500 - 80) // 20 + 1))
    for k, p in got.items():
        assert abs(p - sum((x[k * 20 : k * 20 + 80] ** 2).mean() for x in found.values())) < 1e-9


def test_empty_and_nulls(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert S.resampled(none, 2, 3, 64).count() == S.band_passed(none, 64, 0.1, 0.2).count() == S.recursive_filter(none, [(1, 0, 0, 0, 0)], 64).count() == 0
    assert S.section_correlations(none, none, 64, 10).count() == S.rechunked(S.as_pieces(none, 64), 5).count() == 0
    c = spark.createDataFrame([("a", 0, 0, [1.0, None, 2.0, 3.0]), ("a", 0, 1, [4.0])], SCHEMA)
    close(joined(S.recursive_filter(c, [(1.0, 1.0, 0.0, 0.0, 0.0)], 4)), {("a", 0): np.array([1.0, 1, 2, 5, 7])})
    close(joined(S.band_passed(c, 4, 0.0, 0.5)), {("a", 0): np.array([1.0, 0, 2, 3, 4, 0, 0, 0])})
