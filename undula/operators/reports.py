"""Whole reports: on recordings, on pairs of recordings, on a collection with its index.

Each is one plan over tables of chunks, with a row for each recording or pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula import params as P
from undula.functions.scalar import level_db
from undula.operators import audio as AU
from undula.operators import frames as FR
from undula.operators import index as IX
from undula.operators import levels as LV
from undula.operators import nulls as NU
from undula.operators import pairs as PR
from undula.operators import series as SE
from undula.operators import spectrum as SP
from undula.operators.sized import kept

_PART = "\x1f"


def projected(chunks: DataFrame, channel: str) -> DataFrame:
    """Chunks of one channel made of all: mix, left, right, mid or side (a recording of one channel stays as it is); "all" keeps each."""
    if channel in ("all", "mix"):
        return chunks if channel == "all" else AU.mixed(chunks)
    both = chunks.groupBy("file", "chunk").agg(F.max("sr").alias("sr"), F.array_sort(F.collect_list(F.struct("ch", "x"))).alias("c"))
    first, second = F.get("c", F.lit(0))["x"], F.get("c", F.lit(1))["x"]
    made = F.zip_with(first, second, lambda a, b: {"left": a, "right": b, "mid": (a + b) / 2, "side": (a - b) / 2}[channel].cast("float"))
    return both.select("file", F.lit(0).alias("ch"), "chunk", "sr", F.when(F.size("c") < 2, first).otherwise(made).alias("x"))


def channel_labels(channels: Column, layout: Column) -> Column:
    """Names of the channels of a recording."""
    named = lambda text: F.array(*map(F.lit, text.split()))
    layout = F.lower(F.coalesce(layout, F.lit("")))
    surround = F.when(layout.contains("5.1") & (channels == 6), named("L R C LFE Ls Rs")).when(layout.contains("7.1") & (channels == 8), named("L R C LFE Ls Rs Lb Rb"))
    return F.when(channels == 2, named("Left Right")).otherwise(F.coalesce(surround, F.transform(F.sequence(F.lit(1), channels), lambda k: F.concat(F.lit("Channel "), k.cast("string")))))


def cut(chunks: DataFrame, chunk: int, start: Column, seconds: Column | None) -> DataFrame:
    """The same recordings from ``start`` seconds on, for at most ``seconds``, in chunks of the same length."""
    first = F.floor(start * F.col("sr")).cast("long")
    whole, off = F.floor(first / chunk).cast("long"), F.pmod(first, F.lit(chunk)).cast("int")
    extra = [c for c in chunks.columns if c not in ("file", "ch", "chunk", "sr", "x")]
    head = AU.with_head(chunks, chunk).join(chunks.select("file", "ch", "chunk", *extra), ["file", "ch", "chunk"]) if extra else AU.with_head(chunks, chunk)
    k = F.col("chunk") - whole
    left = F.lit(chunk) if seconds is None else F.least(F.lit(chunk).cast("long"), F.floor(seconds * F.col("sr")) - k * chunk)
    moved = head.filter(k >= 0).select("file", "ch", k.alias("chunk"), "sr", F.slice("x", off + 1, F.greatest(left, F.lit(0)).cast("int")).alias("x"))
    return moved.filter(F.size("x") > 0)


def sliced(chunks: DataFrame, p: P.Params, chunk: int) -> DataFrame:
    if p.start is None and p.duration is None:
        return chunks
    return cut(chunks, chunk, F.lit(p.start or 0.0), None if p.duration is None else F.lit(p.duration))


def spectra_columns(chunks: DataFrame, p: P.Params, chunk: int, *, pooled: bool = True) -> DataFrame:
    """(file, ch, col, mags) of the channel and slice of time that ``p`` asks for, stored: what follows reads it several times."""
    p = p.validated()
    held = projected(sliced(chunks, p, chunk), p.channel).withColumn("file", F.concat_ws(_PART, F.col("file").cast("string"), "ch"))
    columns = kept(AU.stft(FR.hop_frames(held, p.nfft, p.hop, chunk), p.window))
    columns = SP.pooled_columns(columns, p.max_cols) if pooled else columns
    parts = F.split("file", _PART)
    return columns.select(parts[0].alias("file"), parts[1].cast("int").alias("ch"), "col", "mags")


def spectra(chunks: DataFrame, p: P.Params, chunk: int, *, pooled: bool = True) -> DataFrame:
    """(file, ch, col, bin, mag) of the channel and slice of time that ``p`` asks for."""
    return spectra_rows(spectra_columns(chunks, p, chunk, pooled=pooled))


def spectra_rows(columns: DataFrame) -> DataFrame:
    return columns.select("file", "ch", "col", F.posexplode("mags").alias("bin", "mag")).withColumn("bin", F.col("bin").cast("long"))


def panels(rows: DataFrame, *, normalize: bool = True) -> DataFrame:
    """(file, ch, col, bin, db): levels below the strongest place of all channels of the recording, or of full scale."""
    if not normalize:
        return rows.select("file", "ch", "col", "bin", level_db(F.col("mag"), 1.0).alias("db"))
    top = rows.groupBy("file").agg(F.max("mag").cast("double").alias("_top"))
    return rows.join(top, "file").select("file", "ch", "col", "bin", level_db(F.col("mag") / F.when(F.col("_top") > 0, F.col("_top")).otherwise(1.0), 1.0).alias("db"))


def band_report(chunks: DataFrame, codecs: DataFrame, p: P.Params, sr: int, chunk: int, **edge) -> DataFrame:
    """Band analysis of the mix at its fixed frame size, whatever that of ``p`` is, over the slice of time of ``p``."""
    fixed = P.Params(nfft=P.REFERENCE_NFFT, overlap=0.5, channel="mix", start=p.start, duration=p.duration)
    return SP.band_analysis(spectra_columns(chunks, fixed, chunk, pooled=False), codecs, sr, P.REFERENCE_NFFT, **edge)


def _with_band(info: DataFrame, band: DataFrame) -> DataFrame:
    return info.drop("codec").join(band, "file", "left").withColumn("cutoff_hz", F.coalesce("edge_hz", "signal_bandwidth_hz"))


def quickcheck(chunks: DataFrame, info: DataFrame, sr: int, chunk: int, *, seconds: float = 60.0, nfft: int = 4096, **edge) -> DataFrame:
    """A row for each recording (file, name, codec, duration, ...) from an excerpt of its middle."""
    starts = info.select("file", AU.centre(F.coalesce("duration", F.lit(0.0)), seconds).alias("_start"))
    middle = cut(chunks.join(starts, "file"), chunk, F.col("_start"), F.lit(seconds))
    columns = spectra_columns(middle, P.Params(nfft=nfft, overlap=0.5, max_cols=800), chunk)
    band = SP.band_analysis(columns, info.select("file", "codec"), sr, nfft, **edge)
    return _with_band(info, band).select(*info.columns, "cutoff_hz", "edge_hz", "pattern", "verdict_key", "level")


def summary(chunks: DataFrame, info: DataFrame, p: P.Params, sr: int, chunk: int, **edge) -> DataFrame:
    """A row for each recording with all measurements: band, tones, shares, low end, levels, stereo, clipping, dynamics.  Loudness is measured at 48 kHz only."""
    p = p.validated()
    # Sound and spectra are read many times, so each is stored once; spectra stay arrays.
    chunks = kept(chunks)
    held = sliced(chunks, p, chunk)
    spectra_ = kept(spectra_columns(chunks, p, chunk).filter("ch = 0").select("file", "col", "mags"))
    columns = spectra_.groupBy("file").agg((F.max("col") + 1).alias("columns"))
    band = band_report(chunks, info.select("file", "codec"), p, sr, chunk, **edge)
    band = band.select("file", F.coalesce("edge_hz", "signal_bandwidth_hz").alias("cutoff_hz"), F.struct(*(c for c in band.columns if c != "file")).alias("band"))
    tones = SP.tonal_peaks(spectra_, sr, p.nfft).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("rank", "hz", "prominence_db", "level_db", "share"))).alias("tones"))
    shares = SP.band_shares(FR.bins_of(spectra_), sr / p.nfft, sr / 2).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("band", "lo_hz", "share"))).alias("bands"))
    factor = max(d for d in range(1, max(2, sr // 4000 + 1)) if chunk % d == 0)
    low = AU.lowfreq_scan(AU.decimated(AU.mixed(held), factor, chunk), sr // factor, chunk // factor)
    low = low.select("file", F.struct(*(c for c in low.columns if c != "file")).alias("lowfreq"))
    samples = AU.samples_of(held, chunk)
    levels = LV.level_stats(samples, "file").join(held.filter(F.size("x") > 0).groupBy("file").agg(F.max(F.col("chunk") * chunk + F.size("x")).alias("_n")), "file")
    # Flat tops: how much longer than a single sample the longest run at the peak of a channel is.
    flat = LV.flat_runs(samples, "file", "ch").groupBy("file").agg((F.max("longest_flat") - 1).cast("double").alias("flat_factor"))
    levels = levels.join(flat, "file", "left")
    levels = levels.join(AU.loudness(held, chunk, sr=sr).withColumnRenamed("true_peak_dbfs", "_tp"), "file", "left").withColumn("true_peak_dbfs", F.col("_tp")).drop("_tp")
    levels = LV.dynamics_note(LV.clipping_verdict(levels, F.col("_n") / sr))
    levels = levels.select("file", F.struct(*(c for c in levels.columns if c not in ("file", "_n"))).alias("levels"), F.bround(F.col("_n") / sr, 3).alias("analysed_duration"))
    # The chunks of both channels meet, and only those of two channels become samples.
    both = held.filter("ch < 2").groupBy("file", "chunk").agg(F.max(F.when(F.col("ch") == 0, F.col("x"))).alias("l"), F.max(F.when(F.col("ch") == 1, F.col("x"))).alias("r")).filter("r IS NOT NULL")
    none = F.array().cast("array<float>")
    two = both.select("file", F.inline(F.arrays_zip(F.coalesce("l", none).alias("l"), F.col("r").alias("r")))).filter("r IS NOT NULL")
    stereo = LV.stereo_stats(two, "file").select("file", F.struct("correlation", "side_ratio_db", "identical_channels").alias("stereo"))
    out = info
    for part in (columns, band, tones, shares, low, levels, stereo):
        out = out.join(part, "file", "left")
    return out


def scan(files: DataFrame, index: DataFrame, chunks: DataFrame, info: DataFrame, sr: int, chunk: int, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, fresh index rows, summary) of a collection: stored results where they are valid, a quick check of all other files.

    ``files``: root, path, kind, analysis_version, mtime_ns, size; ``info`` and ``chunks`` have the path as their file.
    """
    misses = IX.index_misses(files, index)
    asked = misses.select(F.col("path").alias("file"))
    found = quickcheck(chunks.join(asked, "file", "left_semi"), info.join(asked, "file", "left_semi"), sr, chunk, **options)
    fresh = misses.join(found.select(F.col("file").alias("path"), "level"), "path", "left").withColumn("error", F.when(F.col("level").isNull(), "not read"))
    cached = IX.index_hits(files, index).withColumns({"cached": F.lit(True), "error": F.lit(None).cast("string")})
    rows = cached.unionByName(fresh.withColumn("cached", F.lit(False)))
    return rows, fresh, IX.scan_summary(rows)


def null_report(a: DataFrame, b: DataFrame, p: P.Params, sr: int, chunk: int, *, max_seconds: float = 300.0, least_seconds: float = 1.0) -> DataFrame:
    """What is left of each recording when the other, aligned and levelled, is taken away."""
    p = p.validated()
    p = P.Params(**{**p.__dict__, "duration": min(p.duration or max_seconds, max_seconds)})
    a, b = (AU.mixed(sliced(x, p, chunk)) for x in (a, b))
    lags = kept(AU.null_test_chunks(a, b, sr, chunk))
    out = NU.null_test(kept(NU.aligned(a, b, lags, chunk))).filter(F.col("n") >= least_seconds * sr).join(lags, "file")
    return out.select("file", F.col("lag").alias("offset_samples"), F.bround(F.col("lag") / sr * 1000, 3).alias("offset_ms"), F.bround("gain_db", 3).alias("gain_db"), F.bround("correlation", 5).alias("correlation"), F.bround("residual_db", 2).alias("residual_db"), F.bround("residual_peak_db", 2).alias("residual_peak_db"), F.bround(F.col("n") / sr, 2).alias("analysed_seconds"), "verdict_key", "level")


def residual(a: DataFrame, b: DataFrame, p: P.Params, sr: int, chunk: int, *, max_seconds: float = 900.0, gain_db: float = 0.0, half: int = 2048) -> tuple[DataFrame, DataFrame]:
    """(chunks of the residual, ready to be written as sound or as a table; a row for each recording with what explains it)."""
    p = p.validated()
    p = P.Params(**{**p.__dict__, "duration": min(p.duration or max_seconds, max_seconds)})
    a, b = (sliced(x, p, chunk) for x in (a, b))
    lags = kept(AU.null_test_chunks(a, b, sr, chunk))
    both = kept(NU.from_start(kept(NU.aligned(a, b, lags, chunk))))
    sums = NU.pair_sums(both)
    gain = F.col("xy") / (F.col("yy") + PR.EPS)
    sums = sums.withColumn("gain", F.when((F.abs(gain) > 1e-3) & (F.abs(gain) < 1e3), gain).otherwise(1.0))
    left = kept(NU.with_residual(both, sums))
    boost = 10 ** (gain_db / 20)
    loud_ = F.transform("r", lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v * boost)))
    sound = SE.rechunked(left.select("file", "ch", "first", loud_.alias("x")), chunk).select("file", "ch", "chunk", F.lit(sr).alias("sr"), F.col("x").cast("array<float>").alias("x"))
    # The mean of the channels: what is taken as channel 0, its residual as channel 1, in chunks of whole half frames.
    size = -(-chunk // half) * half
    mono = kept(SE.rechunked(NU.two_means(left), size))
    energy = NU.half_frames(mono, size, half)
    after = energy.select("file", (F.col("frame") - 1).alias("frame"), F.col("ea").alias("_a"), F.col("er").alias("_r"))
    db = lambda x, y: 10 * F.log10((F.col(x) + F.col(y)) / (2 * half) + F.lit(1e-30))
    frames = energy.join(after, ["file", "frame"]).select("file", "frame", db("ea", "_a").alias("ea"), db("er", "_r").alias("er"))
    terciles = PR.terciles(frames, "file")
    rest = left.groupBy("file").agg(F.sum("rr").alias("rr"), F.max("peak_r").alias("peak_r"))
    # the shapes of both in the third of frames with most level
    n = frames.groupBy("file").agg(F.greatest(F.lit(1), F.floor(F.count("*") / 3)).alias("k"), F.count("*").alias("m"))
    loud = PR.ranked(frames, "file").join(n, "file").filter(F.col("rank") > F.col("m") - F.col("k")).select("file", "frame")
    framed = FR.hop_frames(mono.withColumn("x", F.col("x").cast("array<float>")), 2 * half, half, size).join(loud, ["file", "frame"])
    rows = FR.bins_of(AU.stft(framed.withColumn("file", F.struct("file", "ch")))).select("file.*", "bin", "mag")
    of = lambda ch, name: F.avg(F.when(F.col("ch") == ch, F.col("mag").cast("double") ** 2)).alias(name)
    power = rows.groupBy("file", "bin").agg(of(0, "pa"), of(1, "pr")).select("file", "bin", (10 * F.log10(F.col("pa") + F.lit(1e-30))).alias("sa"), (10 * F.log10(F.col("pr") + F.lit(1e-30))).alias("sb"))
    df_hz = sr / (2 * half)
    inside = F.col("bin").between(int(200 / df_hz), int(min(8000, sr / 2 - 100) / df_hz) - 1)
    shapes = PR.shape_correlation(power.filter(inside), "file")
    out = sums.join(rest, "file").join(lags, "file").join(terciles, "file", "left").join(shapes, "file", "left")
    rms_a, rms_r = F.sqrt(F.col("xx") / F.col("n")) + F.lit(PR.EPS), F.sqrt(F.col("rr") / F.col("n")) + F.lit(PR.EPS)
    crest_r, crest_a = 20 * F.log10((F.col("peak_r") + F.lit(PR.EPS)) / rms_r), 20 * F.log10((F.col("peak_a") + F.lit(PR.EPS)) / rms_a)
    level, keys = PR.residual_verdict(crest_r - crest_a, F.bround("quiet_rel_db", 1), F.bround("loud_rel_db", 1), F.bround("shape_correlation", 3))
    row = out.select(
        "file", F.bround(crest_r, 1).alias("crest_db"), F.bround(crest_a, 1).alias("source_crest_db"), F.bround("quiet_rel_db", 1).alias("quiet_rel_db"), F.bround("loud_rel_db", 1).alias("loud_rel_db"), F.bround("shape_correlation", 3).alias("shape_correlation"),
        F.col("lag").alias("offset_samples"), F.bround(F.col("lag") / sr * 1000, 3).alias("offset_ms"), F.bround(20 * F.log10(F.abs("gain") + F.lit(PR.EPS)), 3).alias("gain_db"), F.bround(20 * F.log10(rms_r / rms_a), 2).alias("residual_db"),
        F.bround(20 * F.log10(F.col("peak_r") + F.lit(PR.EPS)), 2).alias("residual_peak_db"), F.bround(F.col("last") / sr, 2).alias("seconds"), keys.alias("verdict_keys"), level.alias("level"),
    )
    return sound, row
