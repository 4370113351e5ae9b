"""Measurements of sound: from tables of chunks to one row (or a few) for each file.

Kernels run on Arrow batches, one chunk with the head of the next at a time, and
give one value or one short spectrum for each frame; from there on all is joins,
windows and aggregates, for all files at once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undula import params as P

from undula.functions import dsp
from undula.functions.scalar import power_db
from undula.operators import events as EV
from undula.operators import frames as FR
from undula.operators import series as SE
from undula.operators import spectrum as SP
from undula.operators.batches import DOUBLES, FLOATS, by_slices
from undula.operators.quantiles import grouped_median
from undula.operators.sized import kept, small


def mixed(chunks: DataFrame) -> DataFrame:
    """The mean of all channels, as channel 0.  A chunk has a row for each channel, so what is gathered is bounded."""
    both = chunks.groupBy("file", "chunk").agg(F.max("sr").alias("sr"), F.transform(F.array_sort(F.collect_list(F.struct("ch", "x"))), lambda s: s["x"]).alias("xs"))
    total = F.aggregate(F.slice("xs", 2, F.greatest(F.size("xs") - 1, F.lit(0))), F.transform(F.get("xs", F.lit(0)), lambda v: v.cast("double")), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    return both.select("file", F.lit(0).alias("ch"), "chunk", "sr", F.transform(total, lambda v: (v / F.size("xs")).cast("float")).alias("x"))


def excerpt(chunks: DataFrame, chunk: int, sr: int, *, start: float = 0.0, seconds: float | None = None) -> DataFrame:
    """Whole chunks from the one that holds ``start``; a filter on the chunk's number, so it reaches the scan of a stored table."""
    first = int(start * sr) // chunk
    out = chunks.filter(F.col("chunk") >= first)
    return out if seconds is None else out.filter(F.col("chunk") < first + max(1, int(seconds * sr) // chunk))


def centre(duration: Column, seconds: float) -> Column:
    """Where an excerpt from the middle starts."""
    return F.greatest(F.lit(0.0), (duration - seconds) / 2)


def with_head(chunks: DataFrame, n: int) -> DataFrame:
    """Each chunk with up to n samples of the next one behind it; ``own`` is its own length."""
    head = chunks.select("file", "ch", (F.col("chunk") - 1).alias("chunk"), F.slice("x", 1, n).alias("_head"))
    joined = F.concat("x", F.coalesce("_head", F.array().cast("array<float>")))
    return chunks.join(head, ["file", "ch", "chunk"], "left").select("file", "ch", "chunk", "sr", F.size("x").alias("own"), joined.alias("x"))


def stft(frames: DataFrame, window: str = "hann") -> DataFrame:
    """(file, ch, frame, x) -> (file, ch, col, mags)"""

    def spectra(x: pd.Series) -> list[np.ndarray]:
        return list(dsp.magnitudes(np.stack(x.to_numpy()).astype(np.float64), window).astype(np.float32))

    # A few frames at a time, so that a task holds little besides its batch.
    mags = by_slices(spectra, "array<float>", FLOATS)
    return frames.select("file", "ch", F.col("frame").alias("col"), mags("x").alias("mags"))


def spectrogram(chunks: DataFrame, p: P.Params, chunk: int) -> DataFrame:
    """(file, col, bin, mag) of the mix, columns pooled to less than twice ``max_cols``."""
    p = p.validated()
    return FR.max_pool(FR.bins_of(stft(FR.hop_frames(mixed(chunks), p.nfft, p.hop, chunk), p.window)), p.max_cols)


def decimated(chunks: DataFrame, factor: int, chunk: int) -> DataFrame:
    """Low-passed by a windowed sinc and thinned; ``chunk`` must be a multiple of ``factor``."""
    taps = 16 * factor + 1
    t = np.arange(taps) - taps // 2
    h = np.sinc(t / factor * 0.9) * np.hanning(taps)
    h /= h.sum()

    @F.pandas_udf("array<float>")
    def thin(x: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([np.convolve(np.pad(v, (0, taps)), h[::-1], "valid")[:n:factor].astype(np.float32) for v, n in zip(x, own)])

    return with_head(chunks, taps - 1).select("file", "ch", "chunk", (F.col("sr") / factor).cast("int").alias("sr"), thin("x", "own").alias("x"))


def verdict(key: Column, level: Column) -> list[Column]:
    return [key.alias("verdict_key"), level.alias("level")]


def impulse_scan(chunks: DataFrame, sr: int, chunk: int, *, threshold_db: float = 14.0, max_ms: float = 6.0, lf_margin: float = 6.0) -> tuple[DataFrame, DataFrame]:
    """Clicks: treble that jumps over its background for a few milliseconds while the bass does not.  (events, summary)"""
    nfft, hop = 256, 64
    df_hz = sr / nfft
    lo = int(6000 / df_hz)
    hi = max(lo + 2, int(min(0.45 * sr, 20000) / df_hz) if sr > 50000 else nfft // 2 + 1)
    bass = max(2, int(1000 / df_hz))
    if chunk % hop:
        raise ValueError("a chunk must be a multiple of 64 samples")

    @F.pandas_udf("array<struct<hf:double,lf:double>>")
    def envelopes(x: pd.Series) -> pd.Series:
        w = np.hanning(nfft).astype(np.float32)
        out = []
        for v in x:
            if len(v) < nfft:
                out.append([])
                continue
            frames = np.lib.stride_tricks.sliding_window_view(np.asarray(v, np.float32), nfft)[::hop]
            s = np.abs(np.fft.rfft(frames * w, axis=1)).astype(np.float32) ** 2
            hf, lf = 10 * np.log10(s[:, lo:hi].sum(axis=1) + 1e-20), 10 * np.log10(s[:, :bass].sum(axis=1) + 1e-20)
            out.append([{"hf": float(a), "lf": float(b)} for a, b in zip(hf, lf)])
        return pd.Series(out)

    mono = mixed(chunks)
    levels = with_head(mono, nfft - hop).select("file", "chunk", F.posexplode(envelopes("x")).alias("k", "e"))
    levels = levels.select("file", (F.col("chunk") * (chunk // hop) + F.col("k")).alias("frame"), "e.hf", "e.lf")
    over = EV.block_background(levels, ["hf", "lf"], max(8, int(0.5 * sr / hop))).select("file", "frame", (F.col("hf") - F.col("hf_base")).alias("over_h"), (F.col("lf") - F.col("lf_base")).alias("over_l"))
    frame_ms = hop / sr * 1000
    widest = max(1, int(max_ms / frame_ms))
    found = EV.hysteresis_events(over, "over_h", threshold_db, companions=("over_l",))
    found = found.filter((F.col("frames") <= widest) & (F.col("peak") - F.col("peak_over_l") >= lf_margin))
    events = found.select("file", F.bround(F.col("first") * hop / F.lit(float(sr)), 3).alias("t"), F.bround("peak", 1).alias("db"), F.bround(F.col("frames") * F.lit(frame_ms), 2).alias("ms"))
    length = mono.groupBy("file").agg((F.sum(F.size("x")) / F.lit(float(sr))).alias("seconds"))
    counts = events.groupBy("file").agg(F.count("*").alias("count"), F.count_if(F.col("db") >= 25).alias("strong_count"))
    out = length.join(counts, "file", "left").withColumn("count", F.coalesce("count", F.lit(0))).withColumn("strong_count", F.coalesce("strong_count", F.lit(0)))
    rate = F.col("count") / (F.col("seconds") / 60)
    key = F.when(rate < 2, "imp.none").when(rate < 20, "imp.few").when(rate < 100, "imp.many").otherwise("imp.constant")
    return events, out.select("file", "count", F.bround(rate, 1).alias("per_minute"), "strong_count", F.bround("seconds", 2).alias("analysed_seconds"), *verdict(key, F.when(rate < 20, "ok").otherwise("warn")))


def strongest_events(events: DataFrame, most: int = 300) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("file").orderBy(F.col("db").desc(), "t"))
    return events.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")


def _longest_frames(chunks: DataFrame, sizes: list[int], chunk: int) -> DataFrame:
    """(file, size, x): frames at half overlap, of the first of the falling ``sizes`` that a recording fills; one that fills none has a frame of zeros."""
    nfft, least = sizes[0], sizes[-1]
    if chunk < nfft:
        # Chunks that hold a frame; an empty recording stays one.
        empty = chunks.filter((F.col("chunk") == 0) & (F.size("x") == 0)).select("file", "ch", "chunk", "x")
        chunks = SE.rechunked(chunks.withColumn("first", F.col("chunk") * chunk), nfft).unionByName(empty)
        chunk = nfft
    # Read three times below, so that it is stored.
    chunks = kept(chunks)
    n, size = F.size("x"), F.col("size")
    # All chunks but the last are full, so a first one without a frame is the whole recording.
    whole = (F.col("chunk") == 0) & (n < nfft)
    long_ = FR.hop_frames(chunks.filter(~whole), nfft, nfft // 2, chunk).select("file", F.lit(nfft).alias("size"), "x")
    short = chunks.filter(whole).select("file", F.coalesce(*(F.when(n >= s, s) for s in sizes), F.lit(least)).alias("size"), F.when(n < least, F.array_repeat(F.lit(0.0).cast("float"), least)).otherwise(F.col("x")).alias("x"))
    hop = (size / 2).cast("int")
    frames = F.transform(F.sequence(F.lit(0), F.floor((n - size) / hop).cast("int")), lambda f: F.slice("x", f * hop + 1, size))
    return long_.unionByName(short.select("file", "size", F.explode(frames).alias("x")))


def lowfreq_scan(chunks: DataFrame, sr: int, chunk: int, *, nfft: int = 16384, least: int = 1024) -> DataFrame:
    """Rumble and hum of sound thinned to about 4 kHz: levels, mains frequency, harmonics that stand out, verdict keys.

    Recordings shorter than a frame of ``nfft`` have frames of a half, a quarter and so on, down to ``least``, and so wider bins.
    """
    sizes = [nfft >> k for k in range(nfft.bit_length()) if nfft >> k >= min(least, nfft)]
    df_hz = F.lit(float(sr)) / F.col("size")

    def spectra(x: pd.Series) -> list[np.ndarray]:
        return [(dsp.magnitudes(np.asarray(v, np.float64)[None])[0] / (np.hanning(len(v)).sum() / 2)) ** 2 for v in x]

    power = by_slices(spectra, "array<double>", DOUBLES, rows=64)
    framed = _longest_frames(mixed(chunks), sizes, chunk)
    rows = framed.select("file", "size", F.posexplode(power("x")).alias("bin", "p"))
    med = grouped_median(rows, ["file", "size", "bin"], F.col("p"), "power")
    med = med.withColumn("db", power_db(F.col("power")))
    # What surrounds a tone: 6 Hz, but more than twice the four bins that a tone fills itself, or nothing could stand out.
    around = {s: max(9, int(6 / (sr / s)) | 1) for s in sizes}
    base = F.coalesce(*(F.when(F.col("size").isin([s for s in sizes if around[s] == k]), SP.smoothed(med, "db", k)) for k in sorted(set(around.values()))))
    med = med.withColumn("prominence", F.col("db") - base)

    def band(lo: float, hi: float) -> Column:
        return power_db(F.coalesce(F.sum(F.when((F.col("bin") >= F.floor(lo / df_hz)) & (F.col("bin") < F.floor(hi / df_hz)), F.col("power"))), F.lit(0.0)))

    # A harmonic is looked for in three bins on either side, in wide bins no further than half way from 50 to 60 Hz.
    reach = F.least(F.lit(3), F.greatest(F.lit(1), F.floor(5 / df_hz)))
    asked = F.array(*(F.struct(F.lit(f0).alias("f0"), F.lit(k).alias("k"), F.rint(f0 * k / df_hz).cast("int").alias("i")) for f0 in (50, 60) for k in range(1, 7)))
    near = F.filter(asked, lambda h: (h["i"] < F.col("size") / 2 - 1) & (F.abs(F.col("bin") - h["i"]) <= reach))
    peaks = med.withColumn("h", F.explode(near)).groupBy("file", "size", "h").agg(F.max(F.struct("db", (-F.col("bin")).alias("b"), "prominence")).alias("m"))
    peak = F.struct(F.col("h.k").alias("k"), F.bround(-F.col("m.b") * df_hz, 2).alias("hz"), F.bround("m.prominence", 1).alias("prominence_db"), F.bround("m.db", 1).alias("level_db"))
    mains = peaks.groupBy("file", F.col("h.f0").alias("f0")).agg(F.sum(F.greatest(F.lit(0.0), F.bround("m.prominence", 1))).alias("score"), F.array_sort(F.collect_list(peak)).alias("hum"))
    best = mains.groupBy("file").agg(F.max(F.struct("score", (-F.col("f0")).alias("f"), F.filter("hum", lambda h: (h["prominence_db"] >= 14) & (h["level_db"] > -95)).alias("hum"))).alias("m"))
    out = med.groupBy("file").agg(band(1, 20).alias("subsonic"), band(20, 200).alias("bass"), band(1, 2000).alias("total")).join(best.select("file", (-F.col("m.f")).alias("mains"), F.col("m.hum").alias("hum")), "file")
    strong = F.size("hum") > 0
    worst = F.array_max(F.transform("hum", lambda h: h["level_db"]))
    rel = F.col("subsonic") - F.col("total")
    hum_key = F.when(strong & (worst > -70), "low.hum").when(strong, "low.hum_weak")
    rumble = F.when((F.col("subsonic") > -55) & (rel > -12), "low.rumble").when((F.col("subsonic") > -55) & (rel > -25), "low.rumble_mild")
    keys = F.array_compact(F.array(hum_key, rumble))
    return out.select(
        "file", *(F.bround(c, 1).alias(f"{c}_db") for c in ("subsonic", "bass", "total")), F.bround(rel, 1).alias("subsonic_rel_db"), F.when(strong, F.col("mains")).alias("mains_hz"), "hum",
        F.when(F.size(keys) > 0, keys).otherwise(F.array(F.lit("low.clean"))).alias("verdict_keys"), F.when((hum_key == "low.hum") | (rumble == "low.rumble"), "warn").otherwise("ok").alias("level"),
    )


def steady_tones(chunks: DataFrame, sr: int, chunk: int, *, least_share: float = 0.2) -> DataFrame:
    """(file, carrier): the strongest tone of each file from 25 Hz on, if it holds that share of the power, by the mean spectrum of its chunks."""

    @F.pandas_udf("array<double>")
    def power(x: pd.Series) -> pd.Series:
        return pd.Series([dsp.magnitudes(np.pad(np.asarray(v, np.float64), (0, chunk - len(v)))[None])[0] ** 2 for v in x])

    hz = F.col("bin") * F.lit(sr / chunk)
    rows = chunks.select("file", F.posexplode(power("x")).alias("bin", "p")).groupBy("file", "bin").agg(F.sum("p").alias("p"))
    peak = rows.groupBy("file").agg(F.max(F.when(hz >= 25, F.struct("p", (-F.col("bin")).alias("b")))).alias("m"), F.sum("p").alias("all"))
    near = rows.join(peak, "file").filter(F.abs(F.col("bin") + F.col("m.b")) <= 3)
    tone = near.groupBy("file").agg(F.sum("p").alias("part"), F.sum(hz * F.col("p")).alias("moment"), F.max("all").alias("all"))
    return tone.filter((F.col("part") >= least_share * (F.col("all") + F.lit(dsp.EPS)))).select("file", (F.col("moment") / F.col("part")).alias("carrier")).filter("carrier >= 40")


def wow_flutter(chunks: DataFrame, sr: int, chunk: int, *, nominal_hz: float | None = None, seconds: float = 30.0) -> DataFrame:
    """Speed and its variation at a steady tone, of an excerpt of at most ``seconds``.

    Each chunk gives the tone's frequency a thousand times a second, which is all that is gathered for a file.
    """
    step = max(1, sr // 1000)
    edge, least = sr // (4 * step), 1000

    @F.pandas_udf("array<double>")
    def ticks(x: pd.Series, at: pd.Series, own: pd.Series, carrier: pd.Series) -> pd.Series:
        return pd.Series([dsp.tick_frequencies(np.asarray(v, np.float64), int(k) * chunk, int(n), sr, c, step) for v, k, n, c in zip(x, at, own, carrier)])

    @F.pandas_udf("struct<wow_pct:double,flutter_pct:double,combined_pct:double,dominant_mod_hz:double>")
    def varies(hz: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([dsp.modulation(np.asarray(v, np.float64), sr / step) for v in hz], columns=["wow_pct", "flutter_pct", "combined_pct", "dominant_mod_hz"])

    held = excerpt(mixed(chunks), chunk, sr, seconds=seconds)
    followed = with_head(held, chunk).join(steady_tones(held, sr, chunk), "file").select("file", "chunk", ticks("x", "chunk", "own", "carrier").alias("hz"))
    whole = followed.groupBy("file").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "hz"))), lambda s: s["hz"])).alias("hz"))
    n = F.size("hz")
    whole = whole.withColumn("hz", F.when(n > 2 * edge + least, F.slice("hz", edge + 1, n - 2 * edge)).otherwise(F.col("hz"))).filter(n >= least)
    mean = F.aggregate("hz", F.lit(0.0), lambda s, v: s + v) / n
    found = whole.withColumn("m", varies("hz")).select("file", mean.alias("carrier_hz"), "m.*", (n * F.lit(step / sr)).alias("analysed_seconds"))
    out = held.select("file").distinct().join(found, "file", "left")
    carrier = F.col("carrier_hz")
    if nominal_hz is None:
        nearest = F.array_min(F.array(*(F.struct(F.abs(carrier / n - 1).alias("d"), F.lit(n).alias("n")) for n in P.NOMINAL_TONES)))
        nominal = F.when(nearest["d"] < 0.06, nearest["n"])
    else:
        nominal = F.lit(float(nominal_hz))
    deviation = (carrier / nominal - 1) * 100
    speed = F.when(F.abs(deviation) < 0.3, "wow.speed_ok").when(F.abs(deviation) < 1, "wow.speed_off").when(deviation.isNotNull(), "wow.speed_far")
    total = F.when(F.col("combined_pct") < 0.1, "wow.good").when(F.col("combined_pct") < 0.25, "wow.fair").when(F.col("combined_pct").isNotNull(), "wow.poor")
    turns = F.lit(None).cast("string")
    for hz in (1.3, 0.75, 0.555):
        turns = F.when((F.abs(F.col("dominant_mod_hz") - hz) < 0.15) & (F.col("wow_pct") > 0.03), "wow.eccentric").otherwise(turns)
    return out.select(
        "file", F.bround(carrier, 3).alias("carrier_hz"), nominal.alias("nominal_hz"), F.bround(deviation, 3).alias("speed_deviation_pct"), *(F.bround(c, 4).alias(c) for c in ("wow_pct", "flutter_pct", "combined_pct")),
        F.bround("dominant_mod_hz", 2).alias("dominant_mod_hz"), F.bround("analysed_seconds", 1).alias("analysed_seconds"), F.array_compact(F.array(speed, total, turns)).alias("verdict_keys"),
        F.when(carrier.isNull(), "error").when(total == "wow.poor", "warn").otherwise("ok").alias("level"),
    )


def tone_steps(chunks: DataFrame, sr: int, chunk: int, *, block: float = 0.25, least: float = 1.2) -> DataFrame:
    """(file, start, seconds, hz, level_0, level_1): tones held for at least ``least`` seconds."""
    n = int(sr * block)
    if chunk % n:
        raise ValueError("a chunk must be a multiple of a block")
    # One narrow row a file; a recording of one channel has it on both sides, and a side that ends before the other is silent from there on.
    two = chunks.groupBy("file").agg((F.max("ch") > 0).alias("_two"))
    side = lambda ch: F.max(F.when(F.col("ch") == ch, F.col("x")))  # noqa: E731  a chunk has one row for each channel
    both = chunks.groupBy("file", "chunk").agg(side(0).alias("l"), side(1).alias("r")).join(small(two), "file")
    none = F.array().cast("array<float>")
    both = both.select("file", "chunk", F.coalesce("l", none).alias("l"), F.when(F.col("_two"), F.coalesce("r", none)).otherwise(F.coalesce("l", none)).alias("r"))

    @F.pandas_udf("array<struct<m:array<double>,l:array<double>,r:array<double>>>")
    def spectra(l: pd.Series, r: pd.Series) -> pd.Series:  # noqa: E741
        out = []
        for a, b in zip(l, r):
            m = max(len(a), len(b)) // n
            x = [np.pad(np.asarray(v[: m * n], np.float64), (0, max(0, m * n - len(v)))).reshape(m, n) for v in (a, b)]
            each = [dsp.magnitudes(v) ** 2 for v in (sum(x) / 2, *x)]
            out.append([dict(zip("mlr", one)) for one in zip(*each)])
        return pd.Series(out)

    first = math.ceil(25 * n / sr)  # the lowest bin of a tone
    place = F.array_position(F.slice("s.m", first + 1, n), F.array_max(F.slice("s.m", first + 1, n))).cast("int") + first - 1
    blocks = both.select("file", "chunk", F.posexplode(spectra("l", "r")).alias("k", "s")).withColumn("from", F.greatest(place - 2, F.lit(0)))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    near = {c: F.slice(f"s.{c}", F.col("from") + 1, 5) for c in "mlr"}
    centre = total(F.transform(near["m"], lambda v, i: v * (F.col("from") + i))) / (total(near["m"]) + F.lit(dsp.EPS)) * F.lit(sr / n)
    rules = total(near["m"]) >= F.lit(0.5) * (total(F.col("s.m")) + F.lit(dsp.EPS))
    level = lambda c: F.when(rules, 20 * F.log10(F.sqrt(total(near[c])) / n + F.lit(dsp.EPS)))
    rows = blocks.select("file", (F.col("chunk") * (chunk // n) + F.col("k")).alias("frame"), F.when(rules, centre).alias("hz"), level("l").alias("level_0"), level("r").alias("level_1"))
    runs = EV.stable_runs(rows, "hz", 0.03, also=("level_0", "level_1"))
    seconds = F.col("frames") * F.lit(block)
    return runs.filter(seconds >= least).select("file", F.bround(F.col("first") * F.lit(block), 2).alias("start"), F.bround(seconds, 2).alias("seconds"), F.bround("median", 1).alias("hz"), F.bround("level_0", 1).alias("level_0"), F.bround("level_1", 1).alias("level_1"))


def _close(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(b, F.lit(1.0)) < 0.03


def merged_steps(steps: Column) -> Column:
    """An ordered fold: a step close to the one before is averaged into it, pair by pair, rounded each time."""

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        both = F.struct(last["hz"].alias("hz"), F.bround((last["db"] + s["db"]) / 2, 1).alias("db"))
        return F.when((F.size(done) > 0) & _close(s["hz"], F.get(done, F.size(done) - 1)["hz"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(steps, F.array().cast("array<struct<hz:double,db:double>>"), lambda d, s: F.when(F.size(d) == 0, F.array(s)).otherwise(add(d, s)))


def longest_run(steps: Column) -> Column:
    """The first longest run of steps that go one way in frequency; a run begins anew at the step that breaks it."""
    empty = F.array().cast("array<struct<hz:double,db:double>>")

    def add(st: Column, s: Column) -> Column:
        run = st["run"]
        n = F.size(run)
        last, before = F.get(run, n - 1)["hz"], F.get(run, n - 2)["hz"]
        goes_on = (n == 0) | (~_close(s["hz"], last) & ((n < 2) | ((s["hz"] - last) * (last - before) > 0)))
        best = F.when(n > F.size(st["best"]), run).otherwise(st["best"])
        return F.when(goes_on, F.struct(st["best"].alias("best"), F.concat(run, F.array(s)).alias("run"))).otherwise(F.struct(best.alias("best"), F.array(s).alias("run")))

    return F.aggregate(steps, F.struct(empty.alias("best"), empty.alias("run")), add, lambda st: F.when(F.size(st["run"]) > F.size(st["best"]), st["run"]).otherwise(st["best"]))


def tone_sweep(chunks: DataFrame, sr: int, chunk: int, *, reference_hz: float = 1000.0) -> tuple[DataFrame, DataFrame]:
    """(response by file and channel, channel separation by file) from a ladder of held tones."""
    steps = tone_steps(chunks, sr, chunk)
    left = F.col("level_0") >= F.col("level_1")
    two = chunks.groupBy("file").agg((F.max("ch") > 0).alias("two"))
    steps = steps.join(two, "file").withColumn("channel", F.when(~F.col("two"), "M").when(left, "L").otherwise("R")).withColumn("level_db", F.greatest("level_0", "level_1"))
    steps = steps.withColumn("crosstalk_db", F.when(F.col("two"), F.bround(F.greatest("level_0", "level_1") - F.least("level_0", "level_1"), 1)))
    ladder = F.transform(F.array_sort(F.collect_list(F.struct("start", F.col("hz").alias("hz"), F.col("level_db").alias("db")))), lambda s: F.struct(s["hz"].alias("hz"), s["db"].alias("db")))
    runs = steps.groupBy("file", "channel").agg(F.count("*").alias("n"), ladder.alias("s")).filter("n >= 4").withColumn("best", longest_run(merged_steps(F.col("s")))).filter(F.size("best") >= 4)
    ref = F.array_min(F.transform("best", lambda s: F.struct(F.abs(s["hz"] - reference_hz).alias("d"), s["db"].alias("db"))))
    runs = runs.withColumn("ref", ref).filter(F.col("ref.d") <= reference_hz * 0.2)
    curve = F.array_sort(F.transform("best", lambda s: F.struct(s["hz"].alias("hz"), F.bround(s["db"] - F.col("ref.db"), 1).alias("db"))))
    runs = runs.withColumn("curve", curve)
    inside = F.transform(F.filter("curve", lambda s: s["hz"].between(40, 10000)), lambda s: s["db"])
    highs = F.array_min(F.transform(F.filter("curve", lambda s: s["hz"] > 10000), lambda s: s["db"]))
    span = F.bround(F.array_max(inside) - F.array_min(inside), 1)
    response = runs.select("file", "channel", "curve", span.alias("span_db"), F.when(highs < -6, "sweep.highs").alias("highs_key"), F.when(span > 6, "warn").otherwise("ok").alias("level"))
    apart = steps.filter(F.col("crosstalk_db").isNotNull() & F.col("hz").between(200, 8000)).groupBy("file").agg(F.percentile("crosstalk_db", 0.5).alias("m"), F.min("crosstalk_db").alias("low"))
    key = F.when(F.col("m") >= 25, "sweep.sep_good").when(F.col("m") >= 15, "sweep.sep_fair").otherwise("sweep.sep_poor")
    return response, apart.select("file", F.bround("m", 1).alias("channel_separation_db"), F.bround("low", 1).alias("channel_separation_min_db"), *verdict(key, F.when(F.col("m") < 15, "warn").otherwise("ok")))


def loudness(chunks: DataFrame, chunk: int, *, sr: int = 48000) -> DataFrame:
    """Integrated loudness, loudness range and true peak of sound of one rate by the published gating rules.

    Sound is weighted by recursive filters in order of time, at any rate; 400 ms blocks every 100 ms, gates and percentiles are aggregates.
    """

    @F.pandas_udf("double")
    def peak(x: pd.Series) -> pd.Series:
        def one(v):
            s = np.fft.rfft(np.asarray(v, np.float64))
            return float(max(np.abs(v).max(initial=0), np.abs(np.fft.irfft(s, 4 * len(v)) * 4).max(initial=0))) if len(v) else 0.0

        return pd.Series([one(v) for v in x], dtype=float)

    lufs = lambda p: F.lit(-0.691) + 10 * F.log10(p + F.lit(1e-30))
    chunks = chunks.filter(F.col("sr") == sr)
    blocks = SE.short_powers(SE.recursive_filter(chunks, SE.k_weighting_sections(sr), chunk), sr, chunk)
    gate1 = blocks.filter(lufs(F.col("p")) > -70)
    level = gate1.groupBy("file").agg(lufs(F.avg("p")).alias("l1"))
    whole = gate1.join(level, "file").filter(lufs(F.col("p")) > F.col("l1") - 10).groupBy("file").agg(lufs(F.avg("p")).alias("lufs_integrated"))
    # 3 s windows every second: blocks are spread to the windows that hold them, an equi-key
    spread = blocks.withColumn("w", F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col("frame") - 26) / 10)).cast("long"), F.floor(F.col("frame") / 10).cast("long")))) .filter(F.col("frame") - F.col("w") * 10 <= 26)
    short = spread.groupBy("file", "w").agg(F.avg("p").alias("p"), F.count("*").alias("n")).filter("n = 27").filter(lufs(F.col("p")) > -70)
    mean = short.groupBy("file").agg(lufs(F.avg("p")).alias("l"))
    spans = short.join(mean, "file").filter(lufs(F.col("p")) > F.col("l") - 20).groupBy("file").agg(F.percentile(lufs(F.col("p")), F.array(F.lit(0.1), F.lit(0.95))).alias("q"))
    tops = chunks.select("file", peak("x").alias("t")).groupBy("file").agg((20 * F.log10(F.max("t") + F.lit(dsp.EPS))).alias("true_peak_dbfs"))
    out = tops.join(whole, "file", "left").join(spans, "file", "left")
    return out.select("file", F.bround("lufs_integrated", 1).alias("lufs_integrated"), F.bround(F.get("q", F.lit(1)) - F.get("q", F.lit(0)), 1).alias("lra"), F.bround("true_peak_dbfs", 1).alias("true_peak_dbfs"))


def null_test_chunks(a: DataFrame, b: DataFrame, sr: int, chunk: int, *, seconds: float = 30.0) -> DataFrame:
    """(file, lag): the lag of ``b`` in samples, by cross-correlation of excerpts from the middle of both, of equal and bounded length."""

    def lag(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = (np.concatenate(r["x"].to_list()).astype(np.float64) for r in (rows[rows["side"] == s].sort_values("chunk") for s in ("a", "b")))
        return pd.DataFrame([{"file": rows["file"].iloc[0], "lag": dsp.strongest_lag(x, y) + int(rows["apart"].iloc[0])}])

    sides = {"a": mixed(a), "b": mixed(b)}
    sizes = [df.groupBy("file").agg(F.sum(F.size("x")).alias(f"n_{s}")) for s, df in sides.items()]
    length = F.least(F.lit(int(seconds * sr)), "n_a", "n_b")
    spans = sizes[0].join(sizes[1], "file").select("file", length.alias("n"), *(F.floor((F.col(f"n_{s}") - length) / 2).alias(f"from_{s}") for s in "ab"))

    def middle(s: str) -> DataFrame:
        start, end = F.col(f"from_{s}") - F.col("chunk") * chunk, F.col(f"from_{s}") + F.col("n") - F.col("chunk") * chunk
        met = sides[s].join(small(spans), "file").filter((start < F.size("x")) & (end > 0))
        first = F.greatest(start, F.lit(0)).cast("int")
        cut = F.slice("x", first + 1, (F.least(end, F.size("x")) - first).cast("int"))
        return met.select("file", F.lit(s).alias("side"), "chunk", cut.alias("x"), (F.col("from_a") - F.col("from_b")).alias("apart"))

    return middle("a").unionByName(middle("b")).groupBy("file").applyInPandas(lag, "file string, lag long")


def edge_report(chunks: DataFrame, codecs: DataFrame, sr: int, chunk: int) -> DataFrame:
    """Band analysis at its fixed frame size, whatever the size of the picture."""
    columns = kept(stft(FR.hop_frames(mixed(chunks), P.REFERENCE_NFFT, P.REFERENCE_NFFT // 2, chunk)))
    return SP.band_analysis(columns, codecs, sr, P.REFERENCE_NFFT)


def samples_of(chunks: DataFrame, chunk: int) -> DataFrame:
    """(file, ch, pos, x), one row for each sample: for sums that the JVM does well."""
    return chunks.select("file", "ch", "chunk", F.posexplode("x").alias("k", "x")).select("file", "ch", (F.col("chunk") * chunk + F.col("k")).alias("pos"), "x")


