"""Levels, stereo sums, loudness and the verdicts on them.  Sums are partial aggregates; nothing is sorted but the runs of flat tops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undula.functions.scalar import EPS
from undula.operators.events import running_sum
from undula.operators.sized import small


def _x() -> Column:
    return F.col("x").cast("double")


def db20(v: Column) -> Column:
    return 20 * F.log10(v + F.lit(EPS))


def level_stats(samples: DataFrame, *by: str) -> DataFrame:
    """(keys, pos, x) -> peak, RMS, crest, DC offset, sample count and how often the peak is reached."""
    peak = samples.groupBy(*by).agg(F.max(F.abs(_x())).alias("peak"), F.sqrt(F.avg(_x() * _x())).alias("rms"), F.avg(_x()).alias("dc_offset"), F.count("x").alias("samples"))
    at = samples.join(peak.select(*by, "peak"), list(by)).filter(F.abs(_x()) == F.col("peak")).groupBy(*by).agg(F.count("*").alias("abs_peak_count"))
    out = peak.join(at, list(by), "left").withColumn("peak_dbfs", db20(F.col("peak"))).withColumn("rms_dbfs", db20(F.col("rms")))
    return out.withColumn("crest_db", F.bround(F.col("peak_dbfs") - F.col("rms_dbfs"), 2)).withColumn("abs_peak_count", F.coalesce("abs_peak_count", F.lit(0)))


def flat_runs(samples: DataFrame, *by: str, order: str = "pos") -> DataFrame:
    """Longest run and number of runs (of two and more) of equal samples at the peak: the flat tops of clipping.

    Samples are numbered by ``order``; only those at the peak are looked at, each beside the one before it, and runs are numbered in spans.
    """
    peaks = samples.groupBy(*by).agg(F.max(F.abs(_x())).alias("_peak"))
    tops = samples.join(small(peaks), list(by)).filter(F.abs(_x()) == F.col("_peak")).select(*by, order, "x")
    before = tops.select(*by, (F.col(order) + 1).alias(order), F.col("x").alias("_before"))
    marked = tops.join(before, [*by, order], "left").select(F.struct(*by).alias("_key"), order, F.when(F.col("_before") == F.col("x"), 0).otherwise(1).alias("_start"))
    runs = running_sum(marked, F.col("_start"), "_run", file="_key", order=order).groupBy("_key", "_run").agg(F.count("*").alias("n"))
    return runs.groupBy("_key").agg(F.max("n").alias("longest_flat"), F.count_if(F.col("n") >= 2).alias("flat_runs")).select("_key.*", "longest_flat", "flat_runs")


def stereo_stats(pairs: DataFrame, *by: str) -> DataFrame:
    """(keys, l, r) -> uncentred correlation, side ratio and identical channels, from one pass of sums."""
    left, right = F.col("l").cast("double"), F.col("r").cast("double")
    mid, side = (left + right) / 2, (left - right) / 2
    sums = pairs.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(left * right).alias("lr"), F.sum(left * left).alias("ll"), F.sum(right * right).alias("rr"),
        F.sum(mid * mid).alias("mm"), F.sum(side * side).alias("ss"),
    )
    return sums.select(
        *by, "n", (F.col("lr") / (F.sqrt(F.col("ll") * F.col("rr")) + EPS)).alias("correlation"),
        (10 * F.log10((F.col("ss") + EPS) / (F.col("mm") + EPS))).alias("side_ratio_db"), (F.col("ss") < 1e-9 * (F.col("mm") + EPS)).alias("identical_channels"),
    )


def clipping_verdict(levels: DataFrame, seconds: Column) -> DataFrame:
    """levels: peak_dbfs, true_peak_dbfs, flat_factor, abs_peak_count.  Adds rate_per_min, clip_level and clip_key (null: nothing to say)."""
    rate = F.when(seconds > 0, F.coalesce("abs_peak_count", F.lit(0)) / (seconds / 60)).otherwise(0.0)
    clipped = (F.col("peak_dbfs") > -1.0) & ((F.coalesce("flat_factor", F.lit(0.0)) > 0) | (rate >= 30))
    key = F.when(clipped, "clip.clipped").when(F.col("true_peak_dbfs") > -0.1, "clip.truepeak")
    return levels.withColumn("rate_per_min", F.bround(rate, 1)).withColumn("clip_key", key).withColumn("clip_level", F.when(key.isNotNull(), "warn"))


def dynamics_note(levels: DataFrame) -> DataFrame:
    """levels: crest_db, lufs_integrated.  Adds dyn_key (null: nothing to say)."""
    return levels.withColumn("dyn_key", F.when((F.col("crest_db") < 12.5) & (F.col("lufs_integrated") > -12), "dyn.compressed"))


def depth_gate(sample_fmt: Column, effective: Column, container: Column) -> tuple[Column, Column]:
    """(bits, inflated): the effective depth counts only for whole-number formats; inflated if the container has 2 bits more."""
    whole = sample_fmt.rlike("^(s16|s32|u8|s64)")
    bits = F.when(whole, effective)
    return bits, F.coalesce(container - bits >= 2, F.lit(False))


def trapezoid_rms(psd: DataFrame, lo: float, hi: float, *by: str) -> DataFrame:
    """(keys, f, p) -> square root of the integral of p over lo <= f < hi."""
    w = W.partitionBy(*by).orderBy("f")
    cut = psd.filter((F.col("f") >= lo) & (F.col("f") < hi))
    area = (F.col("p") + F.lead("p").over(w)) / 2 * (F.lead("f").over(w) - F.col("f"))
    return cut.withColumn("_a", area).groupBy(*by).agg(F.sqrt(F.coalesce(F.sum("_a"), F.lit(0.0))).alias("rms"))
