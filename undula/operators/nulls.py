"""Two aligned recordings as pairs of arrays: sums, residuals and energies, a row a chunk and never a row a sample."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.functions.scalar import EPS
from undula.operators import series as SE
from undula.operators.sized import small


def aligned(a: DataFrame, b: DataFrame, lags: DataFrame, chunk: int) -> DataFrame:
    """(file, ch, chunk, first, x, y): equally long arrays of ``a`` and ``b`` on the time of ``b``, where both have samples.

    ``a`` is moved by whole pieces: each is cut at the borders of the chunks of ``b``, so a lag costs one shuffle of arrays.
    """
    moved = SE.as_pieces(a, chunk).join(small(lags.select("file", "lag")), "file").select("file", "ch", (F.col("first") - F.col("lag")).alias("first"), "x")
    x = SE.rechunked(moved, chunk, with_first=True)
    y = b.select("file", "ch", "chunk", (F.col("chunk") * chunk).cast("long").alias("_b"), F.col("x").cast("array<double>").alias("y"))
    met = x.join(y, ["file", "ch", "chunk"])
    start, end = F.greatest("first", "_b"), F.least(F.col("first") + F.size("x"), F.col("_b") + F.size("y"))
    cut = lambda c, first: F.slice(c, (start - F.col(first) + 1).cast("int"), (end - start).cast("int")).alias(c)
    return met.filter(end > start).select("file", "ch", "chunk", cut("x", "first"), cut("y", "_b"), start.alias("first"))


def from_start(pairs: DataFrame) -> DataFrame:
    """``pairs`` counted from the first sample that a file has."""
    start = pairs.groupBy("file").agg(F.min("first").alias("_from"))
    return pairs.join(small(start), "file").withColumn("first", F.col("first") - F.col("_from")).drop("_from")


def pair_sums(pairs: DataFrame) -> DataFrame:
    """(file, n, last, xx, yy, xy, peak_a): sums over all samples of all channels, and how far they go."""

    @F.pandas_udf("struct<xx: double, yy: double, xy: double, peak: double>")
    def sums(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = [(a @ a, b @ b, a @ b, np.abs(a).max(initial=0)) for a, b in ((np.asarray(a), np.asarray(b)) for a, b in zip(x, y))]
        return pd.DataFrame(rows, columns=["xx", "yy", "xy", "peak"], dtype=float)

    parts = pairs.select("file", F.size("x").alias("n"), (F.col("first") + F.size("x")).alias("last"), sums("x", "y").alias("s"))
    return parts.groupBy("file").agg(F.sum("n").alias("n"), F.max("last").alias("last"), *(F.sum(f"s.{c}").alias(c) for c in ("xx", "yy", "xy")), F.max("s.peak").alias("peak_a"))


def with_residual(pairs: DataFrame, gains: DataFrame) -> DataFrame:
    """``pairs`` with r = x - gain * y, its sum of squares and its peak."""

    @F.pandas_udf("struct<r: array<double>, rr: double, peak_r: double>")
    def rest(x: pd.Series, y: pd.Series, gain: pd.Series) -> pd.DataFrame:
        rows = [np.asarray(a) - g * np.asarray(b) for a, b, g in zip(x, y, gain)]
        return pd.DataFrame({"r": rows, "rr": [float(r @ r) for r in rows], "peak_r": [float(np.abs(r).max(initial=0)) for r in rows]})

    joined = pairs.join(small(gains.select("file", "gain")), "file")
    return joined.select("file", "ch", "first", "x", rest("x", "y", "gain").alias("_r")).select("file", "ch", "first", "x", "_r.*")


def null_test(pairs: DataFrame) -> DataFrame:
    """(file, n, gain_db, correlation, residual_db, residual_peak_db, verdict_key, level): correlation is about zero, not the mean."""
    sums = pair_sums(pairs)
    rms_x, rms_y = F.sqrt(F.col("xx") / F.col("n")), F.sqrt(F.col("yy") / F.col("n"))
    gain = F.col("xy") / (F.col("yy") + EPS)
    sums = sums.withColumn("gain", F.when((F.abs(gain) <= 1000) & (F.abs(gain) >= 1e-3), gain).otherwise(rms_x / (rms_y + EPS)))
    left = with_residual(pairs, sums).groupBy("file").agg(F.sum("rr").alias("rr"), F.max("peak_r").alias("peak_r"))
    corr = F.col("xy") / (F.sqrt(F.col("xx") * F.col("yy")) + EPS)
    depth = 20 * F.log10((F.sqrt(F.col("rr") / F.col("n")) + EPS) / (rms_x + 2 * EPS))
    key = F.when(corr < 0.5, "null.unrelated").when(depth < -60, "null.identical").when(depth < -18, "null.lossy").when(depth < -8, "null.mastering").otherwise("null.distant")
    return sums.join(left, "file").select(
        "file", "n", (20 * F.log10(F.abs("gain") + EPS)).alias("gain_db"), corr.alias("correlation"), depth.alias("residual_db"), (20 * F.log10(F.col("peak_r") + EPS)).alias("residual_peak_db"),
        key.alias("verdict_key"), F.when(key.isin("null.identical", "null.lossy"), "ok").otherwise("warn").alias("level"),
    )


def two_means(left: DataFrame) -> DataFrame:
    """Pieces of the means over channels: of x as channel 0, of r as channel 1."""
    add = lambda a, b: F.zip_with(a, b, lambda u, v: u + v)
    # A file has few channels, so what is gathered is bounded.
    both = left.groupBy("file", "first").agg(F.collect_list("x").alias("xs"), F.collect_list("r").alias("rs"))
    mean = lambda c: F.transform(F.reduce(F.slice(c, 2, F.size(c)), F.get(c, F.lit(0)), add), lambda v: v / F.size(c))
    sides = F.array(F.struct(F.lit(0).alias("ch"), mean("xs").alias("x")), F.struct(F.lit(1).alias("ch"), mean("rs").alias("x")))
    return both.select("file", "first", F.explode(sides).alias("s")).select("file", "s.ch", "first", "s.x")


def half_frames(mono: DataFrame, chunk: int, half: int) -> DataFrame:
    """(file, frame, ea, er): energies of whole half frames of channels 0 and 1; ``half`` divides ``chunk``."""

    @F.pandas_udf("array<double>")
    def energies(x: pd.Series) -> pd.Series:
        return pd.Series([(np.asarray(v)[: len(v) // half * half].reshape(-1, half) ** 2).sum(1) for v in x])

    parts = mono.select("file", "ch", "chunk", F.posexplode(energies("x")).alias("k", "e"))
    of = lambda ch: F.max(F.when(F.col("ch") == ch, F.col("e")))
    return parts.groupBy("file", (F.col("chunk") * (chunk // half) + F.col("k")).alias("frame")).agg(of(0).alias("ea"), of(1).alias("er"))
