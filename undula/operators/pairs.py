"""Two recordings against each other: differences, alignment, null tests, residuals."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undula.functions.scalar import EPS
from undula.operators.batches import by_slices
from undula.operators.quantiles import grouped_quantiles
from undula.operators.sized import kept, small


LAG_SUMS = pa.list_(pa.struct([("lag", pa.int64()), ("cols", pa.int64()), ("n", pa.int64()), ("s", pa.float64())]))


def difference_stats(a: DataFrame, b: DataFrame, keys: list[str], *by: str) -> DataFrame:
    """(keys, db) each -> median, mean, 90 % and largest absolute difference over the common keys, and a class."""
    d = a.withColumnRenamed("db", "_a").join(b.withColumnRenamed("db", "_b"), [*by, *keys]).withColumn("d", F.col("_a") - F.col("_b"))
    return deviation_stats(d.select(*by, "d"), *by)


def deviation_stats(d: DataFrame, *by: str) -> DataFrame:
    """(by, d) -> median, mean, 90 % and largest absolute value of ``d``, and a class."""
    both = d.select(*by, F.explode(F.array(F.struct(F.lit(False).alias("_abs"), F.col("d").alias("_d")), F.struct(F.lit(True).alias("_abs"), F.abs("d").alias("_d"))))).select(*by, "col.*")
    q = grouped_quantiles(both, [*by, "_abs"], F.col("_d"), [0.5, 0.9], name="_q").groupBy(*by).agg(F.max(F.when(~F.col("_abs"), F.col("_q")[0])).alias("median_db"), F.max(F.when(F.col("_abs"), F.col("_q")[1])).alias("p90_abs_db"))
    sums = d.groupBy(*by).agg(F.avg(F.abs("d")).alias("mean_abs_db"), F.max(F.abs("d")).alias("max_abs_db"))
    out = sums.join(q, list(by)).select(*by, "median_db", "mean_abs_db", "p90_abs_db", "max_abs_db")
    p = F.col("p90_abs_db")
    return out.withColumn("diff_key", F.when(p < 2, "diff.identical").when(p < 8, "diff.moderate").when(p < 15, "diff.strong").otherwise("diff.very_strong")).withColumn("level", F.when(p < 8, "ok").otherwise("warn"))


def lag_scores(a: DataFrame, b: DataFrame, lags: range | Column, *by: str, least: int | Column, col: str = "col", bin_: str = "bin", value: str = "db") -> DataFrame:
    """(keys, lag, cols, score): mean absolute difference with column c + lag of ``a`` on column c of ``b``; lags with fewer than ``least`` common columns are left out.

    The few lags (a range, or an array of ``b``) are exploded on one side, so the shift is part of an equi-join key.
    """
    asked = lags if isinstance(lags, Column) else F.array(*(F.lit(k) for k in lags))
    moved = b.select(*by, F.col(bin_).alias("_bin"), F.col(col).alias("_c"), F.col(value).alias("_y"), F.explode(asked).alias("lag"), (least if isinstance(least, Column) else F.lit(least)).alias("_least"))
    both = a.select(*by, F.col(bin_).alias("_bin"), col, value).join(moved.withColumn(col, F.col("_c") + F.col("lag")), [*by, "_bin", col])
    scored = both.groupBy(*by, "lag").agg(F.countDistinct(col).alias("cols"), F.avg(F.abs(F.col(value) - F.col("_y"))).alias("score"), F.max("_least").alias("_least"))
    return scored.filter(F.col("cols") >= F.col("_least")).drop("_least")


def band_pooled(rows: DataFrame, bins: int, *by: str, bands: int = 64, col: str = "col", value: str = "db") -> DataFrame:
    """(keys, col, bin, value) with the means of ``bands`` nearly equal runs of bins in place of the bins; fewer bins stay as they are."""
    if bins <= bands:
        return rows
    # band k holds the bins from floor(k * bins / bands) on
    band = F.floor(((F.col("bin") + 1) * bands - 1) / F.lit(bins)).cast("long")
    return rows.groupBy(*by, col, band.alias("bin")).agg(F.avg(value).alias(value))


def column_arrays(rows: DataFrame, *by: str, value: str = "db") -> DataFrame:
    """(keys, col, v): the values of a column in order of bins, with nulls for bins that it lacks."""
    width = (rows.agg(F.max("bin").alias("n")).first()["n"] or 0) + 1
    found = rows.groupBy(*by, "col").agg(F.map_from_entries(F.collect_list(F.struct(F.col("bin").cast("int").alias("k"), F.col(value).cast("double").alias("v")))).alias("m"))
    return found.select(*by, "col", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.col("m")[k]).alias("v"))


def _block_sums(i: int, j: int, first: int, last: int, a: np.ndarray, b: np.ndarray, block: int) -> list[dict]:
    """For each lag of ``first`` to ``last``, and 0, that leads from block j of ``b`` into block i of ``a``: common columns, values, sum of absolute differences."""
    out, whole = [], not (np.isnan(a).any() or np.isnan(b).any())
    nearest, furthest = max(1 - block, first - (i - j) * block), min(block - 1, last - (i - j) * block)
    apart = {*range(nearest, furthest + 1), *((k for k in ((j - i) * block,) if abs(k) < block))}
    for d in sorted(apart):
        n = block - abs(d)
        diff = np.abs(a[max(d, 0) : max(d, 0) + n] - b[max(-d, 0) : max(-d, 0) + n])
        met = np.full(n, diff.shape[1]) if whole else (~np.isnan(diff)).sum(axis=1)
        if met.any():
            out.append({"lag": (i - j) * block + d, "cols": int((met > 0).sum()), "n": int(met.sum()), "s": float(diff.sum() if whole else np.nansum(diff))})
    return out


def block_lag_scores(a: DataFrame, b: DataFrame, *by: str, block: int = 1024) -> DataFrame:
    """(keys, lag, cols, score): ``lag_scores`` of columns as arrays, (keys, col, v), for the lags from ``_from`` to ``_to`` of ``b``, and 0, with at least its ``_least`` common columns.

    Columns are put together in blocks, and a block of ``b`` meets the blocks of ``a`` that its lags reach, by an equi-join on the
    block; so what is sent grows with the columns and not with the lags.
    """

    def blocks(df: DataFrame, *also: str) -> DataFrame:
        # A block has a row for each of its columns, so what is gathered is bounded.
        held = df.groupBy(*by, F.floor(F.col("col") / block).cast("long").alias("at")).agg(F.array_sort(F.collect_list(F.struct("col", "v"))).alias("c"), *(F.max(c).alias(c) for c in also))
        return held.select(*by, "at", F.transform("c", lambda c: c["col"]).alias("cols"), F.flatten(F.transform("c", lambda c: c["v"])).alias("v"), *also)

    def matrix(at: int, cols, v) -> np.ndarray:
        m = np.full((block, len(v) // len(cols)), np.nan)
        m[np.asarray(cols) - at * block] = np.asarray(v, np.float64).reshape(len(cols), -1)
        return m

    def sums_of(*columns: pd.Series) -> list[list[dict]]:
        return [_block_sums(p, q, x, y, matrix(p, c, u), matrix(q, d, w), block) for p, q, x, y, c, u, d, w in zip(*columns)]

    # A row holds two blocks, so a few are unpacked together.
    met = by_slices(sums_of, "array<struct<lag: long, cols: long, n: long, s: double>>", LAG_SUMS, rows=4)

    low, high = F.floor((F.col("_j") * block + F.col("_from")) / block), F.floor((F.col("_j") * block + block - 1 + F.col("_to")) / block)
    asked = blocks(b, "_from", "_to", "_least").withColumnsRenamed({"at": "_j", "cols": "_cols", "v": "_v"})
    asked = asked.withColumn("at", F.explode(F.array_union(F.sequence(low.cast("long"), high.cast("long")), F.array("_j"))))
    sums = blocks(a).join(asked, [*by, "at"]).select(*by, "_least", F.explode(met("at", "_j", "_from", "_to", "cols", "v", "_cols", "_v")).alias("r"))
    scored = sums.groupBy(*by, "r.lag").agg(F.sum("r.cols").alias("cols"), (F.sum("r.s") / F.sum("r.n")).alias("score"), F.max("_least").alias("_least"))
    return scored.filter(F.col("cols") >= F.col("_least")).drop("_least")


def align_lags(a: DataFrame, b: DataFrame, *by: str, most: int = 600, value: str = "db", bins: int | None = None) -> DataFrame:
    """(keys, lag) for each pair of recordings: the lag in columns of the least penalised distance; 0 unless it is beaten by more than 2 %.

    The search space is a quarter of the shorter recording; with many columns it goes from pooled columns to single ones.
    Spectra of ``bins`` bins are compared by 64 bands.
    """
    if bins is not None:
        a, b = band_pooled(a, bins, *by, value=value), band_pooled(b, bins, *by, value=value)
    return align_columns(column_arrays(a, *by, value=value), column_arrays(b, *by, value=value), *by, most=most)


def align_columns(a: DataFrame, b: DataFrame, *by: str, most: int = 600) -> DataFrame:
    """``align_lags`` of columns as arrays (keys, col, v)."""
    size = lambda df, name: df.groupBy(*by).agg((F.max("col") + 1).alias(name))
    n, limit, k = F.least("_n_a", "_n_b"), F.col("_limit"), F.col("_k")
    sizes = kept(size(a, "_n_a").join(size(b, "_n_b"), list(by)).withColumn("_n", n))
    sizes = sizes.withColumn("_limit", F.least(F.lit(most), F.floor(F.col("_n") / 4)).cast("int")).withColumn("_k", F.greatest(F.lit(1), F.ceil(F.col("_n") / 400)).cast("int"))
    wide = sizes.filter("_n >= 8 AND _limit >= 1")
    penalised = lambda lag: F.col("score") * (1.0 + F.lit(0.08) * F.abs(lag) / limit.cast("double"))
    about = lambda df, of: df.join(small(of.select(*by, "_n_a", "_n_b", "_n", "_limit", "_k")), list(by))

    def pooled(df: DataFrame, cols: str) -> DataFrame:
        part = about(df, wide.filter("_k > 1")).filter(F.col("col") < F.floor(F.col(cols) / k) * k)
        means = part.select(*by, F.floor(F.col("col") / k).alias("col"), F.posexplode("v").alias("bin", "v")).groupBy(*by, "col", "bin").agg(F.avg("v").alias("v"))
        return means.groupBy(*by, "col").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "v"))), lambda s: s["v"]).alias("v"))

    reach = F.floor(limit / k).cast("int")
    asked = about(pooled(b, "_n_b"), wide).select(*by, "col", "v", (-reach).alias("_from"), reach.alias("_to"), F.greatest(F.lit(8), F.floor(0.7 * F.floor(F.col("_n") / k))).alias("_least"))
    coarse = block_lag_scores(pooled(a, "_n_a"), asked, *by)
    centre = about(coarse, wide).filter(F.abs("lag") <= reach).groupBy(*by).agg((F.min(F.struct(penalised(F.col("lag") * k).alias("s"), "lag")).getField("lag") * F.max("_k")).alias("_centre"))
    fine = wide.join(centre, list(by), "left").withColumn("_centre", F.coalesce("_centre", F.lit(0)))
    fine = fine.withColumn("_from", F.when(k > 1, F.greatest(-limit, F.col("_centre") - k)).otherwise(-limit)).withColumn("_to", F.when(k > 1, F.least(limit, F.col("_centre") + k)).otherwise(limit))
    fine = kept(fine.withColumn("_least", F.greatest(F.lit(8), F.floor(0.7 * F.col("_n")))))
    scores = block_lag_scores(a, b.join(small(fine.select(*by, "_from", "_to", "_least")), list(by)), *by)
    scores = scores.join(fine.select(*by, "_limit", "_from", "_to"), list(by)).withColumn("penalised", penalised(F.col("lag")))
    best = scores.groupBy(*by).agg(F.min(F.when(F.col("lag").between(F.col("_from"), F.col("_to")), F.struct("penalised", "lag"))).alias("m"), F.max(F.when(F.col("lag") == 0, F.col("score"))).alias("zero"))
    keep = F.col("zero").isNotNull() & F.col("m").isNotNull() & (F.col("zero") <= F.col("m.penalised") * 1.02)
    found = best.select(*by, F.when(keep | F.col("m").isNull(), 0).otherwise(F.col("m.lag")).alias("lag"))
    return sizes.select(*by).join(found, list(by), "left").select(*by, F.coalesce("lag", F.lit(0)).alias("lag"))


def cross_correlation(a: DataFrame, b: DataFrame, lags: range, *by: str, value: str = "x", pos: str = "pos") -> DataFrame:
    """(keys, lag, product): sums of products of the mean-free series, ``a`` at p + lag against ``b`` at p.  For long series use ``functions.dsp.strongest_lag``."""
    free = lambda df: df.withColumn("_all", F.lit(0)).join(F.broadcast(df.groupBy(*by, F.lit(0).alias("_all")).agg(F.avg(value).alias("_m"))), [*by, "_all"]).select(*by, pos, (F.col(value) - F.col("_m")).alias("v"))  # noqa: E731  one row a key
    y = free(b).select(*by, F.col(pos).alias("_q"), F.col("v").alias("w"), F.explode(F.array(*(F.lit(k) for k in lags))).alias("lag"))
    both = free(a).join(y.withColumn(pos, F.col("_q") + F.col("lag")), [*by, pos])
    return both.groupBy(*by, "lag").agg(F.sum(F.col("v") * F.col("w")).alias("product"))


def null_test(joined: DataFrame, *by: str) -> DataFrame:
    """(keys, x, y), aligned -> gain, correlation (about zero, not the mean), null depth, residual peak and verdict key."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    sums = joined.groupBy(*by).agg(F.count("*").alias("n"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.sum(x * y).alias("xy"))
    rms_x, rms_y = F.sqrt(F.col("xx") / F.col("n")), F.sqrt(F.col("yy") / F.col("n"))
    gain = F.col("xy") / (F.col("yy") + EPS)
    usable = (F.abs(gain) <= 1000) & (F.abs(gain) >= 1e-3)
    sums = sums.withColumn("gain", F.when(usable, gain).otherwise(rms_x / (rms_y + EPS))).withColumn("rms_a", rms_x)
    residual = joined.join(sums.select(*by, "gain"), list(by)).withColumn("r", x - F.col("gain") * y)
    peak = residual.groupBy(*by).agg(F.max(F.abs("r")).alias("peak_r"), F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("rms_r"))
    out = sums.join(peak, list(by))
    corr = F.col("xy") / (F.sqrt(F.col("xx") * F.col("yy")) + EPS)
    depth = 20 * F.log10((F.col("rms_r") + EPS) / (F.col("rms_a") + 2 * EPS))
    key = F.when(corr < 0.5, "null.unrelated").when(depth < -60, "null.identical").when(depth < -18, "null.lossy").when(depth < -8, "null.mastering").otherwise("null.distant")
    return out.select(
        *by, "n", (20 * F.log10(F.abs("gain") + EPS)).alias("gain_db"), corr.alias("correlation"), depth.alias("residual_db"), (20 * F.log10(F.col("peak_r") + EPS)).alias("residual_peak_db"),
        key.alias("verdict_key"), F.when(key.isin("null.identical", "null.lossy"), "ok").otherwise("warn").alias("level"),
    )


def ranked(frames: DataFrame, *by: str) -> DataFrame:
    """Frames with their rank by ``ea`` in each recording."""
    return frames.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy("ea", "frame")))


def terciles(frames: DataFrame, *by: str) -> DataFrame:
    """(keys, frame, ea, er) -> mean of er - ea over the third of frames with least and with most ea."""
    k = F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    n = frames.groupBy(*by).agg(F.count("*").alias("n"))
    placed = ranked(frames.join(n, list(by)), *by)
    d = F.col("er") - F.col("ea")
    return placed.groupBy(*by).agg(F.avg(F.when(F.col("rank") <= k, d)).alias("quiet_rel_db"), F.avg(F.when(F.col("rank") > F.col("n") - k, d)).alias("loud_rel_db"))


def shape_correlation(spectra: DataFrame, *by: str) -> DataFrame:
    """(keys, bin, sa, sb) -> Pearson correlation of two spectra in dB; 0 where it is not defined."""
    return spectra.groupBy(*by).agg(F.coalesce(F.nanvl(F.corr("sa", "sb"), F.lit(0.0)), F.lit(0.0)).alias("shape_correlation"))


def residual_verdict(crest_gap: Column, quiet: Column, loud: Column, shape: Column) -> tuple[Column, Column]:
    """(level, keys) of a residual, first rule first."""
    follows = (shape > 0.8) & (loud.isNull() | (loud > -20))
    other = F.array_compact(F.array(F.when(quiet > -6, "res.gate"), F.when(loud.isNotNull(), "res.loud"), F.when(follows, "res.follows").when(shape < 0.5, "res.noise")))
    keys = F.when(crest_gap > 20, F.array(F.lit("res.impulses"))).when(F.size(other) > 0, other).otherwise(F.array(F.lit("res.mixed")))
    level = F.when((crest_gap <= 20) & (F.coalesce(loud > -12, F.lit(False)) | F.coalesce(follows, F.lit(False))), "warn").otherwise("ok")
    return level, keys


def remapped_rows(db: DataFrame, axis: DataFrame, df_hz: float, bins: int, *by: str) -> DataFrame:
    """(keys, bin, db) onto the rows (row, hz) of an axis: interpolated where a row spans less than two bins, else its loudest bin.

    Each row of the axis is exploded into the bins that it needs, so the range join is an equi-join on the bin.
    """
    top = bins - 1.000001
    w = W.orderBy("row")
    idx = F.least(F.greatest(F.col("hz") / df_hz, F.lit(0.0)), F.lit(top))
    a = axis.withColumn("idx", idx).withColumn("lower", F.coalesce((F.col("idx") + F.lag("idx").over(w)) / 2, F.col("idx"))).withColumn("upper", F.coalesce((F.col("idx") + F.lead("idx").over(w)) / 2, F.col("idx")))
    wide = F.col("upper") - F.col("lower") >= 2.0
    i0 = F.floor("idx").cast("long")
    first = F.when(wide, F.ceil("lower")).otherwise(i0).cast("long")
    last = F.when(wide, F.greatest(F.ceil("upper") - 1, F.ceil("lower"))).otherwise(i0 + 1).cast("long")
    need = a.select("row", wide.alias("wide"), (F.col("idx") - i0).alias("frac"), i0.alias("i0"), F.explode(F.sequence(first, last)).alias("bin"))
    hit = db.join(need, "bin")
    part = F.when(F.col("bin") == F.col("i0"), F.col("db") * (1 - F.col("frac"))).otherwise(F.col("db") * F.col("frac"))
    return hit.groupBy(*by, "row").agg(F.when(F.max("wide"), F.max("db")).otherwise(F.sum(part)).alias("db"))


def resampled_columns(db: DataFrame, n_out: int, *by: str) -> DataFrame:
    """(keys, col, db): the columns of each recording stretched or squeezed to ``n_out`` by linear interpolation."""
    sizes = db.groupBy(*by).agg((F.max("col") + 1).alias("n"))
    step = F.greatest(F.col("n") - 1.000001, F.lit(0.0)) / F.lit(float(max(n_out - 1, 1)))
    target = sizes.select(*by, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_out - 1).cast("long"))).alias("to"), step.alias("step"))
    target = target.withColumn("at", F.when(F.col("n") == n_out, F.col("to").cast("double")).otherwise(F.least(F.col("to") * F.col("step"), F.greatest(F.col("n") - 1.000001, F.lit(0.0)))))
    target = target.withColumn("i0", F.floor("at").cast("long")).withColumn("frac", F.col("at") - F.col("i0"))
    need = target.select(*by, "to", "frac", "i0", F.explode(F.array(F.col("i0"), F.col("i0") + 1)).alias("col"))
    part = F.when(F.col("col") == F.col("i0"), F.col("db") * (1 - F.col("frac"))).otherwise(F.col("db") * F.col("frac"))
    return db.join(need, [*by, "col"]).groupBy(*by, F.col("to").alias("col")).agg(F.sum(part).alias("db"))
