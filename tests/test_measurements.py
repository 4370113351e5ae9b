"""Made-up sound and tables with known answers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula import params as P
from undula.functions import arrays as A
from undula.functions import dsp
from undula.operators import audio as AU
from undula.operators import events as EV
from undula.operators import frames as FR
from undula.operators import index as IX
from undula.operators import pairs as PR
from undula.operators import spectrum as SP
from undula.plans import audio as PA
from undula.sources import pcm, store


def rows(df):
    return {r.file: r for r in df.collect()}


def test_clicks_are_found(spark):
    events, summary = AU.impulse_scan(PA.clicks(spark), 44100, 16384)
    at = sorted(r.t for r in events.collect())
    assert len(at) == 5 and all(abs(a - b) < 0.05 for a, b in zip(at, (1.0, 2.5, 3.25, 5.0, 6.75)))
    got = rows(summary)
    assert got["clicks"].verdict_key == "imp.many" and got["quiet"]["count"] == 0


def test_chunk_length_does_not_matter(spark):
    """The same sound in chunks of other lengths gives the same events."""
    hit = lambda t, at: F.when(F.abs(t - at) < 0.00004, 0.9).otherwise(0.0)
    # a click is broadband: it counts as one only where the bass has a level of its own, here that of a tone
    sound = {"a": lambda t: [PA.hiss(t, 11, 0.01) + PA.tone(t, 300, 0.15) + hit(t, 1.4861) + hit(t, 0.3715)]}
    bare = {"a": lambda t: [PA.hiss(t, 11, 0.01) + hit(t, 1.4861)]}
    found = []
    for chunk in (8192, 16384, 1 << 17):
        events, _ = AU.impulse_scan(pcm.synthetic(spark, {"a": 2.0}, sound, sr=44100, chunk=chunk), 44100, chunk)
        found.append(sorted(map(tuple, events.collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == 2
    chunks = pcm.synthetic(spark, {"a": 2.0}, sound, sr=44100, chunk=16384)
    x = np.concatenate([r.x for r in chunks.orderBy("chunk").collect()]).astype(np.float32)
    assert [(round(t, 3), f) for _, t, _, f in found[0]] == [(round(a * 64 / 44100, 3), round((b - a + 1) * 64 / 44.1, 2)) for a, b in plain_clicks(x)]
    assert AU.impulse_scan(pcm.synthetic(spark, {"a": 2.0}, bare, sr=44100, chunk=16384), 44100, 16384)[0].count() == len(plain_clicks(
        np.concatenate([r.x for r in pcm.synthetic(spark, {"a": 2.0}, bare, sr=44100, chunk=16384).orderBy("chunk").collect()]).astype(np.float32))) == 0


def plain_clicks(x, sr=44100):
    """Frame by frame: (first, last) of treble over 14 dB above its block medians, back to 7 dB within 6 ms, 6 dB more than the bass has."""
    levels = []
    for at in range(0, len(x) - 255, 64):
        s = np.abs(np.fft.rfft(x[at : at + 256] * np.hanning(256))) ** 2
        levels.append((10 * np.log10(s[int(6000 / (sr / 256)) :].sum() + 1e-20), 10 * np.log10(s[: int(1000 / (sr / 256))].sum() + 1e-20)))
    levels = np.array(levels)
    size = int(0.5 * sr / 64)
    medians = np.array([np.median(levels[k * size : (k + 1) * size], axis=0) for k in range(len(levels) // size)])
    centres = np.arange(len(medians)) * size + size // 2
    over = levels - np.stack([np.interp(np.arange(len(levels)), centres, medians[:, c]) for c in (0, 1)], axis=1)
    out, k = [], 0
    while k < len(over):
        if over[k, 0] < 14:
            k += 1
            continue
        end = k
        while end < len(over) and over[end, 0] > 7:
            end += 1
        if end - k <= int(6 / (64 / sr * 1000)) and over[k:end, 0].max() - over[k:end, 1].max() >= 6:
            out.append((k, end - 1))
        k = end + 1
    return out


def test_low_end(spark):
    got = rows(PA.lowfreq_scan(spark, ""))
    assert (got["hum50"].mains_hz, got["hum60"].mains_hz, got["clean"].mains_hz) == (50, 60, None)
    assert got["rumble"].level == "warn" and got["rumble"].subsonic_db > -55 and "low.rumble" in got["rumble"].verdict_keys


def test_wow(spark):
    got = rows(PA.wow_flutter(spark, ""))
    assert abs(got["wow"].wow_pct - 0.1) < 0.02 and "wow.eccentric" in got["wow"].verdict_keys
    assert got["steady"].combined_pct < 0.001 and abs(got["slow"].speed_deviation_pct + 0.952) < 0.002
    assert got["noise"].level == "error" and got["noise"].carrier_hz is None


def test_sweep(spark):
    r = PA.tone_sweep(spark, "").first()
    assert r.channel == "L" and r.span_db <= 0.5 and abs(r.channel_separation_db - 30) < 1.5 and len(r.curve) == 10


def test_loudness(spark):
    got = rows(PA.loudness_r128(spark, ""))
    assert abs(got["full"].lufs_integrated + 3.0) < 0.1 and abs(got["low"].lufs_integrated + 23.0) < 0.1
    assert abs(got["full"].true_peak_dbfs) < 0.2 and abs(got["low"].true_peak_dbfs + 20) < 0.2


@pytest.mark.parametrize("sr,chunk", [(44100, 20000), (96000, 50000)])
def test_loudness_at_other_rates(spark, sr, chunk):
    sound = {"full": lambda t, ch: np.sin(2 * np.pi * 997 * t), "low": lambda t, ch: 0.1 * np.sin(2 * np.pi * 997 * t)}
    rows_ = [(f, 0, k // chunk, sr, x[k : k + chunk].tolist()) for f, make in sound.items() for x in [make(np.arange(5 * sr) / sr, 0)] for k in range(0, len(x), chunk)]
    got = rows(AU.loudness(spark.createDataFrame(rows_, "file string, ch int, chunk long, sr int, x array<float>"), chunk, sr=sr))
    assert abs(got["full"].lufs_integrated + 3.0) < 0.1 and abs(got["low"].lufs_integrated + 23.0) < 0.1


def test_short_recordings_have_one_frame_of_zeros(spark):
    rows_ = [("short", 0, 0, [1.0] * 9), ("long", 0, 0, [1.0] * 20), ("long", 0, 1, [1.0] * 3), ("empty", 0, 0, [])]
    got = FR.hop_frames(spark.createDataFrame(rows_, "file string, ch int, chunk long, x array<float>"), 10, 5, 20).collect()
    assert sorted((r["file"], r["frame"], sum(r["x"])) for r in got) == [("empty", 0, 0.0), ("long", 0, 10.0), ("long", 1, 10.0), ("long", 2, 10.0), ("short", 0, 0.0)]


def test_lag_is_taken_from_the_middle(spark):
    """A long lead-in of silence on one side, and sides of unlike length."""
    rng = np.random.default_rng(12)
    x = np.concatenate([np.zeros(3000), rng.normal(0, 1, 5000)])
    sides = [x, np.concatenate([x[137:], np.zeros(700)])]
    a, b = (spark.createDataFrame([("f", 0, k // 500, 1000, v[k : k + 500].tolist()) for k in range(0, len(v), 500)], "file string, ch int, chunk long, sr int, x array<float>") for v in sides)
    assert [tuple(r) for r in AU.null_test_chunks(a, b, 1000, 500, seconds=2.0).collect()] == [("f", 137)]


def test_band_edges(spark):
    got = rows(PA.band_edge_audio(spark, ""))
    assert got["cut"].pattern == "constant" and 2700 < got["cut"].edge_hz < 3100 and got["cut"].verdict_key == "band.transcode"
    assert got["full"].pattern == "full" and got["full"].edge_hz is None


def plain_edge(db, df, nyq, least_drop=15.0, from_hz=7000.0, least_steep=10.0):
    """The definition in whole arrays: the largest fall from the median of 1.5 kHz below to that of 0.3 to 4 kHz above,
    moved to the steepest 200 Hz from 0.5 kHz below to 4 kHz above, and its slope over 1 kHz."""
    bins = np.arange(len(db))
    width = max(1, int(150 / df))
    smooth = np.convolve(db, np.full(width, 1 / width), "same")
    places = [i for i in bins if max(int(from_hz / df), 4) <= i < int(0.995 * nyq / df)]
    below = {i: smooth[(bins >= max(4, int((i * df - 1500) / df))) & (bins < i)] for i in places}
    above = {i: smooth[(bins >= int((i * df + 300) / df)) & (bins < int(min(i * df + 4000, nyq) / df))] for i in places}
    falls = {i: np.median(below[i]) - np.median(above[i]) for i in places if min(len(below[i]), len(above[i])) >= 3}
    if not falls or max(falls.values()) < least_drop:
        return None
    where = max(falls, key=lambda i: (falls[i], -i))
    fall, step = falls[where], max(1, int(200 / df))
    window = bins[(bins >= max(1, where - int(500 / df))) & (bins < min(len(db) - 2, where + int(4000 / df)) - step)]
    if len(window) + step > 2:
        where = int(max(window, key=lambda j: (smooth[j] - smooth[j + step], -j)))
    ends = max(1, int((where * df - 500) / df)), min(len(db) - 1, int((where * df + 500) / df))
    slope = (smooth[ends[0]] - smooth[ends[1]]) / max((ends[1] - ends[0]) * df / 1000, 1e-6)
    return (round(where * df, 1), round(float(fall), 1)) if slope >= least_steep else None


@pytest.mark.parametrize("sr,nfft", [(48000, 512), (44100, 1024)])
def test_edges_against_a_loop(spark, sr, nfft):
    rng = np.random.default_rng(nfft)
    df, nyq = sr / nfft, sr / 2
    spectra = []
    for k in range(6):
        db = rng.normal(0, 1, nfft // 2 + 1)
        db[int((9000 + 1500 * k) / df) :] -= 40
        spectra.append(db)
    spectra += [rng.normal(0, 1, nfft // 2 + 1), -np.arange(nfft // 2 + 1) * df / 1000 * 4]
    table = spark.createDataFrame([(k, [float(v) for v in s]) for k, s in enumerate(spectra)], "file int, db array<double>")
    got = {r.file: r.e for r in table.select("file", SP.spectral_edge(F.col("db"), df, nyq).alias("e")).collect()}
    for k, s in enumerate(spectra):
        want = plain_edge(s, df, nyq)
        assert (got[k] is None) == (want is None)
        if want:
            assert abs(got[k].hz - want[0]) < 1e-6 and abs(got[k].drop_db - want[1]) <= 0.1


def test_frames_across_chunks(spark):
    x = np.arange(1000, dtype=np.float32)
    chunks = spark.createDataFrame([("a", 0, k, 8000, [float(v) for v in x[k * 256 : (k + 1) * 256]]) for k in range(4)], pcm.CHUNKS)
    got = {r.frame: r.x for r in FR.hop_frames(chunks, 100, 30, 256).collect()}
    assert sorted(got) == list(range(1 + (1000 - 100) // 30))
    assert all(v[0] == 30 * f and v[-1] == 30 * f + 99 for f, v in got.items())
    with pytest.raises(ValueError):
        FR.hop_frames(chunks, 300, 30, 256)


def test_blocks_and_pools(spark):
    for n in (1, 7, 24, 25, 403):
        for nb in (1, 3, 5):
            got = [r[0] for r in spark.range(n).orderBy("id").select(FR.block_of(F.col("id"), F.lit(n), F.lit(nb))).collect()]
            assert got == [k for k, part in enumerate(np.array_split(np.arange(n), nb)) for _ in part]
    factors = spark.createDataFrame([(n,) for n in (1, 15, 16, 17, 31, 32, 33, 1000)], "n long").select("n", FR.pool_factor(F.col("n"), 8).alias("p")).collect()
    for r in factors:
        assert r.p == next(1 << k for k in range(20) if r.n // (1 << k) < 16)


def test_events_against_a_loop(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 6, 3000)
    want, k = [], 0
    while k < len(x):
        if x[k] >= 12:
            j = k
            while j < len(x) and x[j] > 6:
                j += 1
            want.append((k, j - 1))
            k = j + 1
        else:
            k += 1
    df = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(x)], "file string, frame long, over double")
    for span in (64, 65536):
        EV.SPAN = span
        assert sorted((r["first"], r["last"]) for r in EV.hysteresis_events(df, "over", 12.0).collect()) == want
    assert EV.hysteresis_events(df.limit(0), "over", 12.0).count() == 0


def test_folds(spark):
    steps = [(100.0, 1.0), (101.0, 2.0), (102.0, 4.0), (200.0, 1.0), (400.0, 1.0), (300.0, 1.0), (250.0, 1.0), (200.0, 1.0), (100.0, 1.0)]
    df = spark.createDataFrame([(steps,)], "s array<struct<hz:double,db:double>>").select(AU.merged_steps(F.col("s")).alias("m"), AU.longest_run(AU.merged_steps(F.col("s"))).alias("r")).first()
    assert [tuple(x) for x in df.m] == [(100.0, 2.8), (200.0, 1.0), (400.0, 1.0), (300.0, 1.0), (250.0, 1.0), (200.0, 1.0), (100.0, 1.0)]
    assert [x.hz for x in df.r] == [300.0, 250.0, 200.0, 100.0]


def test_identical_recordings(spark):
    x = spark.createDataFrame([(1, k, float(np.sin(k)), float(np.sin(k)) * 0.5) for k in range(2000)], "file int, pos long, x double, y double")
    r = PR.null_test(x, "file").first()
    assert r.verdict_key == "null.identical" and abs(r.gain_db - 6.0206) < 1e-3 and r.correlation > 0.99999
    level = np.random.default_rng(5).normal(0, 10, (60, 8))
    a = spark.createDataFrame([(c, b, float(level[c, b])) for c in range(60) for b in range(8)], "col long, bin long, db double")
    moved = a.withColumn("col", F.col("col") - 5).filter("col >= 0")
    for n, bands in ((10, 4), (100, 64), (129, 64), (2049, 64), (5, 64)):
        cuts = np.linspace(0, n, bands + 1).astype(int)
        got = PR.band_pooled(spark.range(n).select(F.lit(0).alias("col"), F.col("id").alias("bin"), F.col("id").cast("double").alias("db")), n, bands=bands).orderBy("bin").collect()
        assert [r.db for r in got] == ([np.arange(a, b).mean() for a, b in zip(cuts, cuts[1:])] if n > bands else list(range(n)))
    both = a.withColumn("k", F.lit(1)).unionByName(a.withColumn("k", F.lit(2))).unionByName(a.filter("col < 5").withColumn("k", F.lit(3)))
    other = moved.withColumn("k", F.lit(1)).unionByName(a.withColumn("k", F.lit(2))).unionByName(moved.filter("col < 5").withColumn("k", F.lit(3)))
    assert {r.k: r.lag for r in PR.align_lags(both, other, "k").collect()} == {1: 5, 2: 0, 3: 0}
    long_ = np.random.default_rng(6).normal(0, 10, 1000).cumsum()  # of more than 400 columns: pooled ones first
    wide = spark.createDataFrame([(1, c, 0, float(long_[c])) for c in range(1000)], "k int, col long, bin long, db double")
    assert PR.align_lags(wide, wide.withColumn("col", F.col("col") - 37).filter("col >= 0"), "k").first().lag == 37
    assert dsp.strongest_lag(np.r_[np.zeros(7), np.sin(np.arange(500.0) ** 1.3)], np.sin(np.arange(500.0) ** 1.3)) == 7


def test_wav_round_trip(spark, tmp_path):
    x = np.stack([np.sin(np.arange(30_000) / 10), np.cos(np.arange(30_000) / 7)]).astype(np.float32)
    (tmp_path / "a.wav").write_bytes(pcm.encode_wav(8000, x))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.WAV").write_bytes(b"RIFF\x00\x00\x00\x00WAVEjunk")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "c.wav").write_bytes(b"x")
    (tmp_path / "note.txt").write_bytes(b"x")
    files = pcm.media_files(spark, str(tmp_path))
    found = {r.name: r for r in pcm.probe(files).collect()}
    assert set(found) == {"a.wav", "b.WAV"} and found["b.WAV"].error and found["a.wav"].channels == 2 and found["a.wav"].duration == 3.75 and found["a.wav"].codec == "pcm_f32le"
    chunks = pcm.read_samples(files, chunk=4096)
    got = np.concatenate([r.x for r in chunks.filter("ch = 1").orderBy("chunk").collect()])
    assert np.array_equal(got.astype(np.float32), x[1])
    part = np.concatenate([r.x for r in pcm.read_samples(files, chunk=4096, start=1.0, seconds=0.5).filter("ch = 0").orderBy("chunk").collect()])
    assert np.array_equal(part.astype(np.float32), x[0, 8000:12000])
    mono = AU.mixed(chunks).filter("chunk = 0").first().x
    assert np.allclose(mono, x[:, :4096].mean(axis=0), atol=1e-6)


def test_index_round_trip(spark, tmp_path):
    path = str(tmp_path / "index")
    assert store.read_index(spark, path).count() == 0
    fresh = spark.createDataFrame([("r", f"p{k}", "q", 1, k, 10, "ok", "bad" if k == 2 else None) for k in range(4)], store.INDEX + ", error string")
    first = store.save_index(store.read_index(spark, path), fresh, path)
    index = store.read_index(spark, first)
    assert index.count() == 3  # an error is not stored
    newer = spark.createDataFrame([("r", "p0", "q", 1, 99, 11, "warn")], store.INDEX)
    second = store.read_index(spark, store.save_index(index, newer, path))
    assert {(r.path, r.mtime_ns) for r in second.collect()} == {("p0", 99), ("p1", 1), ("p3", 3)}
    files = second.select("root", "path", "kind", "analysis_version", "mtime_ns", F.when(F.col("path") == "p1", 12).otherwise(F.col("size")).cast("long").alias("size"))
    assert {r.path for r in IX.index_hits(files, second).collect()} == {"p0", "p3"} and {r.path for r in IX.index_misses(files, second).collect()} == {"p1"}
    assert {r.path: r.action for r in IX.prune(second, files.filter("path <> 'p3'"), spark.createDataFrame([("r",)], "root string")).collect()} == {"p0": "keep", "p1": "remove", "p3": "remove"}
    store.export_csv(second, str(tmp_path / "csv"))
    store.export_json(second, str(tmp_path / "json"))
    assert spark.read.option("header", True).option("sep", ";").csv(str(tmp_path / "csv")).count() == 3 and spark.read.json(str(tmp_path / "json")).count() == 3


def test_roots_names_and_params():
    assert IX.parse_roots("Music=/a:Music=/b:/c/d/") == [("music", "Music", "/a"), ("music-2", "Music 2", "/b"), ("d", "d", "/c/d/")]
    p = P.Params(fmin=9.0, fmax=3.0, duration=-1, start=-2.0, max_cols=5).validated()
    assert (p.fmin, p.fmax, p.duration, p.start, p.max_cols) == (3.0, 9.0, None, 0.0, 100)
    assert (P.Params(fmin=-4.0, fmax=-1.0).validated().fmin, P.Params(fmin=-4.0, fmax=-1.0).validated().fmax) == (0.0, None)
    for bad in ({"nfft": 1000}, {"nfft": 16}, {"window": "x"}, {"start": float("nan")}, {"channel": "all?"}, {"overlap": 2.0}, {"sr": 10}, {"fmin": 5.0, "fmax": 5.5}):
        with pytest.raises(P.ParamError):
            P.Params(**bad).validated()


def test_array_functions(spark):
    df = spark.createDataFrame([([3.0, 1.0, 2.0, 5.0],), ([],), ([7.0],)], "a array<double>")
    got = df.select(A.median(F.col("a")).alias("m"), A.moving_mean(F.col("a"), 2).alias("s"), A.first_max(F.col("a")).alias("i")).collect()
    assert [r.m for r in got] == [2.5, None, 7.0] and got[0].s == [1.5, 2.0, 1.5, 3.5] and got[0].i == 3


def test_listing_and_limits(spark):
    df = spark.createDataFrame([("b", False), ("A", False), ("z", True), ("ab", False)], "name string, is_dir boolean")
    assert [r.name for r in IX.listing(df, "A").collect()] == ["z", "A", "ab"]
    part, more = IX.limited(df, 3, "name")
    assert part.count() == 3 and more and not IX.limited(df, 4, "name")[1]
