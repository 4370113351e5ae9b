"""Hum and rumble, whatever the chunks and the length of a recording."""

from __future__ import annotations

import numpy as np
import pytest

from undula import params as P
from undula.operators import audio as AU
from undula.operators import reports as RP
from undula.plans import reports as PR
from undula.sources import pcm

SR, CHUNK = 4800, 1600


def hum(f0, n, sr):
    t = np.arange(n) / sr
    return (0.02 * np.sin(2 * np.pi * f0 * t) + 0.008 * np.sin(4 * np.pi * f0 * t) + np.random.default_rng(n).normal(0, 0.0005, n)).astype(np.float32)


def chunked(spark, sounds, sr, chunk):
    return spark.createDataFrame([(f, 0, k, sr, x[k * chunk : (k + 1) * chunk].tolist()) for f, x in sounds.items() for k in range(max(1, -(-len(x) // chunk)))], pcm.CHUNKS)


def plain(x, sr, nfft=16384, least=1024):
    """(levels, mains, harmonics that stand out) frame by frame."""
    n = nfft
    while n > max(len(x), least):
        n //= 2
    w = np.hanning(n)
    frames = [x[k : k + n].astype(float) for k in range(0, len(x) - n + 1, n // 2)] or [np.zeros(n)]
    med = np.median([(np.abs(np.fft.rfft(f * w)) / (w.sum() / 2)) ** 2 for f in frames], axis=0)
    df, db = sr / n, 10 * np.log10(med + 1e-30)
    kernel, reach = max(9, int(6 / df) | 1), max(1, min(3, int(5 / df)))
    prominence = db - np.convolve(db, np.ones(kernel) / kernel, "same")
    found = {}
    for f0 in (50, 60):
        at = [int(np.argmax(np.where(np.abs(np.arange(len(db)) - round(f0 * k / df)) <= reach, db, -np.inf))) for k in range(1, 7)]
        found[f0] = [(j * df, prominence[j], db[j]) for j in at]
    score = {f0: sum(max(0.0, p) for _, p, _ in h) for f0, h in found.items()}
    mains = 50 if score[50] >= score[60] else 60
    strong = [h for h in found[mains] if h[1] >= 14 and h[2] > -95]
    levels = [10 * np.log10(med[int(lo / df) : int(hi / df)].sum() + 1e-30) for lo, hi in ((1, 20), (20, 200), (1, 2000))]
    return levels, mains if strong else None, strong


@pytest.mark.parametrize("chunk", [CHUNK, 16384])
def test_low_end_by_the_definition(spark, chunk):
    sounds = {f"{f0}_{n}": hum(f0, n, SR) for f0 in (50, 60) for n in (40000, 16384, 16383, 5000, 2048, 1100)}
    sounds |= {"hiss": np.random.default_rng(1).normal(0, 0.05, 40000).astype(np.float32), "little": hum(50, 900, SR), "empty": np.zeros(0, np.float32)}
    got = {r.file: r for r in AU.lowfreq_scan(chunked(spark, sounds, SR, chunk), SR, chunk).collect()}
    assert got.keys() == sounds.keys()
    for name, x in sounds.items():
        levels, mains, strong = plain(x, SR)
        r = got[name]
        assert np.allclose([r.subsonic_db, r.bass_db, r.total_db], levels, atol=0.051) and r.mains_hz == mains
        assert len(r.hum) == len(strong) and all(np.allclose((h.hz, h.prominence_db, h.level_db), s, atol=0.051) for h, s in zip(r.hum, strong))
        # Both tones stand out in every recording that has a frame.
        assert mains == (int(name[:2]) if name[0].isdigit() else None) and len(strong) >= (2 if mains else 0)


def test_short_frames_have_surroundings_too(spark):
    sounds = {"50": hum(50, 20000, 4000), "60": hum(60, 20000, 4000)}
    got = {r.file: r for r in AU.lowfreq_scan(chunked(spark, sounds, 4000, 16000), 4000, 16000, nfft=1024).collect()}
    assert {f: r.mains_hz for f, r in got.items()} == {"50": 50, "60": 60} and all(r.level == "warn" for r in got.values())


def test_summary_tells_hum(spark):
    sounds = {"long": hum(50, 4 * 48000, 48000), "short": hum(60, 24000, 48000), "hiss": np.random.default_rng(2).normal(0, 0.01, 96000).astype(np.float32)}
    info = spark.createDataFrame([(f, f, "mp3", 48000, 1, len(x) / 48000, len(x)) for f, x in sounds.items()], PR.INFO)
    got = {r.file: r.lowfreq for r in RP.summary(chunked(spark, sounds, 48000, 16000), info, P.Params(nfft=512, overlap=0.5), 48000, 16000).collect()}
    assert {f: r.mains_hz for f, r in got.items()} == {"long": 50, "short": 60, "hiss": None}
    assert [round(h.hz / 10) for h in got["long"].hum[:2]] == [5, 10] and got["long"].verdict_keys == ["low.hum"] and got["hiss"].verdict_keys == ["low.clean"]
