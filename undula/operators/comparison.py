"""Two versions of recordings against each other: offset, matched panels, and how their spectra differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula import params as P
from undula.functions.scalar import level_db
from undula.operators import audio as AU
from undula.operators import frames as FR
from undula.operators import pairs as PR
from undula.operators import reports as RP
from undula.operators import series as SE
from undula.operators import spectrum as SP
from undula.operators.sized import kept, small

BANDS = 64


def _side(chunks: DataFrame, side: str, p: P.Params, rate: int, sr: int, chunk: int) -> DataFrame:
    held = RP.projected(RP.sliced(chunks, p, chunk), p.channel)
    held = held.select("file", F.lit(0).alias("ch"), "chunk", F.lit(sr).alias("sr"), F.col("x").cast("array<float>").alias("x")) if rate == sr else (
        SE.to_rate(held.select("file", F.lit(0).alias("ch"), "chunk", F.lit(rate).alias("sr"), "x"), rate, sr, chunk).select("file", "ch", "chunk", F.lit(sr).alias("sr"), F.col("x").cast("array<float>").alias("x"))
    )
    return held.withColumn("file", F.concat(F.lit(side), F.col("file").cast("string")))


def _named(df: DataFrame) -> DataFrame:
    return df.withColumns({"side": F.substring("file", 1, 1), "file": F.substr("file", F.lit(2))})


def _band_means(db: Column, bins: int) -> Column:
    """Means of nearly equal runs of bins; few bins stay as they are."""
    if bins <= BANDS:
        return db
    edges = [k * bins // BANDS for k in range(BANDS + 1)]
    runs = F.arrays_zip(F.array(*map(F.lit, edges[:-1])).alias("a"), F.array(*map(F.lit, edges[1:])).alias("b"))
    return F.transform(runs, lambda r: F.aggregate(F.slice(db, r["a"] + 1, r["b"] - r["a"]), F.lit(0.0), lambda s, v: s + v) / (r["b"] - r["a"]))


def compare(a: DataFrame, b: DataFrame, codecs: DataFrame, p: P.Params, sr: int, chunk: int, *, rates: tuple[int, int] | None = None, align: bool = True, **edge) -> tuple[DataFrame, DataFrame]:
    """(a row for each file that ``a`` and ``b`` both have, panels (file, panel a / b / diff, col, db array)).

    ``rates``: what ``a`` and ``b`` are at; both are brought to ``sr``, which is to be the lower one.  Both are taken at one hop, so that
    their columns stand for the same times.  The later side loses the columns before the other begins; differences are those
    of common columns, in the band that both fill.  If a side is down to one column, that one stands against all of the other.

    Each side is cut and transformed once, into a stored table of arrays, a row a column; offsets, levels and panels come from
    it.  The offset search works on blocks of columns; only its pooled columns and the differences become rows of single values.
    """
    p = p.validated()
    p = P.Params(**{**p.__dict__, "channel": "mix" if p.channel == "all" else p.channel})
    both = _side(a, "a", p, (rates or (sr, sr))[0], sr, chunk).unionByName(_side(b, "b", p, (rates or (sr, sr))[1], sr, chunk))
    both = kept(both)
    bins = p.nfft // 2 + 1
    columns = kept(AU.stft(FR.hop_frames(both, p.nfft, p.hop, chunk), p.window))
    top = kept(columns.groupBy("file").agg(F.max(F.array_max("mags")).cast("double").alias("_top")))
    scale = F.when(F.col("_top") > 0, F.col("_top")).otherwise(1.0)
    held = _named(columns.join(small(top), "file").select("file", "col", "mags", scale.alias("_scale")))
    level = lambda mags, by: F.transform(mags, lambda v: level_db(v / F.col(by), 1.0))

    fixed = p.nfft == P.REFERENCE_NFFT and p.overlap == 0.5 and p.window == "hann"
    framed = columns if fixed else kept(AU.stft(FR.hop_frames(both, P.REFERENCE_NFFT, P.REFERENCE_NFFT // 2, chunk)))
    known = codecs.select("codec", F.explode(F.array(*(F.concat(F.lit(s), F.col("file").cast("string")) for s in "ab"))).alias("file"))
    bands = kept(_named(SP.band_analysis(framed, known, sr, P.REFERENCE_NFFT, **edge).select("file", F.coalesce("edge_hz", "signal_bandwidth_hz").alias("cutoff"), "verdict_key")))
    of = lambda s: bands.filter(F.col("side") == s).select("file", F.col("cutoff").alias(f"cutoff_{s}"), F.col("verdict_key").alias(f"verdict_{s}"))

    sizes = _named(columns.groupBy("file").agg((F.max("col") + 1).alias("n")))
    about = of("a").join(of("b"), "file")
    for s in "ab":
        about = about.join(sizes.filter(F.col("side") == s).select("file", F.col("n").alias(f"_n_{s}")), "file")
    if align:
        means = lambda s: held.filter(F.col("side") == s).select("file", "col", _band_means(level("mags", "_scale"), bins).alias("v"))
        about = about.join(PR.align_columns(means("a"), means("b"), "file"), "file")
    else:
        about = about.withColumn("lag", F.lit(0).cast("long"))
    late = {"a": F.greatest(F.col("lag"), F.lit(0)), "b": F.greatest(-F.col("lag"), F.lit(0))}
    about = about.withColumn("band_hz", F.least("cutoff_a", "cutoff_b", F.lit(sr / 2)))
    about = about.withColumn("_most", F.greatest(F.lit(4), F.floor(F.col("band_hz") / (sr / p.nfft))).cast("int")).withColumn("_one", F.least(F.col("_n_a") - late["a"], F.col("_n_b") - late["b"]) < 2)
    about = kept(about)

    narrow = about.select("file", "lag", "_most", "_one")
    shifted = held.join(small(narrow), "file").withColumn("col", F.col("col") - F.when(F.col("side") == "a", late["a"]).otherwise(late["b"])).filter("col >= 0")
    shifted = shifted.withColumn("_key", F.when(F.col("_one"), 0).otherwise(F.col("col")))
    left, right = (shifted.filter(F.col("side") == s) for s in "ab")
    # Magnitudes are sent, half as wide as their levels.
    matched = left.join(right.select("file", "_key", F.col("col").alias("_col"), F.col("mags").alias("_mags"), F.col("_scale").alias("_scale_b")), ["file", "_key"])
    low = p.db_top - p.db_range
    clip = lambda v: F.greatest(v, F.lit(float(low)))
    # The differences are read many times for their quantiles.
    matched = kept(matched.select("file", F.greatest("col", "_col").alias("col"), "_most", F.zip_with(level("mags", "_scale"), level("_mags", "_scale_b"), lambda x, y: clip(x) - clip(y)).alias("db")))
    stats = PR.deviation_stats(matched.select("file", F.explode(F.slice("db", 1, F.col("_most"))).alias("d")), "file")
    panels = shifted.select("file", F.col("side").alias("panel"), "col", level("mags", "_scale").alias("db")).unionByName(matched.select("file", F.lit("diff").alias("panel"), "col", "db"))
    out = about.join(stats, "file", "left").withColumn("offset_s", F.bround(F.col("lag") * F.lit(p.hop / sr), 4))
    return out.select("file", "offset_s", "cutoff_a", "cutoff_b", "verdict_a", "verdict_b", F.bround("band_hz", 1).alias("band_hz"), *(F.bround(c, 2).alias(c) for c in ("median_db", "mean_abs_db", "p90_abs_db", "max_abs_db")), "diff_key", "level"), panels
