"""Queries over pairs of recordings and axes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from undula.functions import scalar as S
from undula.operators import pairs as PR
from undula.operators import spectrum as SP
from undula.plans.hosting import DF, frames, neighbours, spectra, sql, table

QUERIES, ORACLE = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def r6(c):
    return F.round(c, 6)


def _db(spark, sf):
    return SP.median_power(spectra(spark, sf)).select("file", "bin", S.power_db(F.col("power")).alias("db"))


@query(sql("""
SELECT a, b, round(median(d), 6) AS median_db, round(avg(abs(d)), 6) AS mean_abs_db, round(quantile_cont(abs(d), 0.9), 6) AS p90_abs_db, round(max(abs(d)), 6) AS max_abs_db,
  CASE WHEN quantile_cont(abs(d), 0.9) < 2 THEN 'diff.identical' WHEN quantile_cont(abs(d), 0.9) < 8 THEN 'diff.moderate' WHEN quantile_cont(abs(d), 0.9) < 15 THEN 'diff.strong' ELSE 'diff.very_strong' END AS diff_key,
  CASE WHEN quantile_cont(abs(d), 0.9) < 8 THEN 'ok' ELSE 'warn' END AS level
FROM (SELECT x.file AS a, y.file AS b, 10 * log10(x.power + 1e-30) - 10 * log10(y.power + 1e-30) AS d FROM medians x JOIN medians y ON x.bin = y.bin AND x.file < y.file) GROUP BY a, b"""))
def spectra_diff_stats(spark, sf):
    """All pairs of the ten recordings."""
    db = _db(spark, sf)
    files = db.select("file").distinct()
    pairs = files.select(F.col("file").alias("a")).join(files.select(F.col("file").alias("b")), F.col("a") < F.col("b"))
    left = db.withColumnRenamed("file", "a").join(pairs, "a")
    right = db.withColumnRenamed("file", "b").join(pairs, "b")
    out = PR.difference_stats(left, right, ["bin"], "a", "b")
    return out.select("a", "b", *(r6(c).alias(c) for c in ("median_db", "mean_abs_db", "p90_abs_db", "max_abs_db")), "diff_key", "level")


def _neighbours(spark, sf):
    """(a, b, col, bin, db) of each recording and of the next one there is."""
    rows = spectra(spark, sf).select("file", "col", "bin", S.level_db(F.col("mag"), 1.0).alias("db"))
    return neighbours(rows)


@query(sql("""
SELECT a, b, CAST(lag AS INTEGER) AS lag, cols, round(score, 6) AS score FROM (
  SELECT a.file AS a, b.file AS b, lag, count(DISTINCT a.col) AS cols, avg(abs(20 * log10(greatest(a.mag, 1e-12)) - 20 * log10(greatest(b.mag, 1e-12)))) AS score
  FROM (SELECT unnest(generate_series(-8, 8)) AS lag), spectra a JOIN nexts n ON n.a = a.file JOIN spectra b ON a.bin = b.bin AND b.file = n.b WHERE a.col = b.col + lag GROUP BY 1, 2, 3) WHERE cols >= 8""", "nexts AS (SELECT file AS a, lead(file) OVER (ORDER BY file) AS b FROM (SELECT DISTINCT file FROM frames))"))
def lag_scores(spark, sf):
    """Mean absolute distance of each recording and the one that follows it, by lag."""
    x, y = _neighbours(spark, sf)
    return PR.lag_scores(x, y, range(-8, 9), "a", "b", least=8).withColumn("score", r6("score"))


@query()
def align_lag(spark, sf):
    """The lag of each recording against the one that follows it."""
    x, y = _neighbours(spark, sf)
    return PR.align_lags(x, y, "a", "b", most=8)


HOURLY = """
hours AS (SELECT event_type, CAST(epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 3600000000 AS BIGINT) AS pos, count(*)::DOUBLE AS x FROM events GROUP BY 1, 2),
free AS (SELECT event_type, pos, x - avg(x) OVER (PARTITION BY event_type) AS v, dense_rank() OVER (ORDER BY event_type) AS k FROM hours)
"""


@query(f"WITH {HOURLY} SELECT lo.event_type AS a, hi.event_type AS b, CAST(lag AS INTEGER) AS lag, round(sum(lo.v * hi.v), 6) AS product FROM (SELECT unnest(generate_series(-12, 12)) AS lag), free lo, free hi WHERE hi.k = lo.k + 1 AND lo.pos = hi.pos + lag GROUP BY 1, 2, 3")
def xcorr_lag(spark, sf):
    """Cross-correlation of the hourly counts of each event type and the next one, by lag."""
    e = table(spark, sf, "events")
    hours = e.groupBy("event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("pos")).agg(F.count("*").cast("double").alias("x"))
    types = hours.select("event_type").distinct()
    pairs = types.select(F.col("event_type").alias("a")).join(types.select(F.col("event_type").alias("b")), F.col("a") < F.col("b")).groupBy("a").agg(F.min("b").alias("b"))
    side = lambda c: hours.join(F.broadcast(pairs), F.col("event_type") == F.col(c)).select("a", "b", "pos", "x")  # noqa: E731  a row for each type
    return PR.cross_correlation(side("a"), side("b"), range(-12, 13), "a", "b").withColumn("product", r6("product"))


PAIRED = (
    "long_ AS (SELECT file, col * 64 + i AS pos, v FROM (SELECT file, col, unnest(generate_series(0, 63)) AS i, unnest(x) AS v FROM frames))",
    "paired AS (SELECT a.file AS a, b.file AS b, a.pos, a.v AS x, 0.5 * a.v + b.v AS y FROM long_ a JOIN long_ b ON a.pos = b.pos AND a.file < b.file)",
    "sums AS (SELECT a, b, count(*) AS n, sum(x * x) AS xx, sum(y * y) AS yy, sum(x * y) AS xy, sum(x * y) / (sum(y * y) + 1e-12) AS gain FROM paired GROUP BY a, b)",
    """nulls AS (SELECT s.*, (SELECT max(abs(p.x - s.gain * p.y)) FROM paired p WHERE p.a = s.a AND p.b = s.b) AS peak, xy / (sqrt(xx * yy) + 1e-12) AS corr,
       20 * log10((sqrt(greatest(xx - 2 * gain * xy + gain * gain * yy, 0) / n) + 1e-12) / (sqrt(xx / n) + 2e-12)) AS depth FROM sums s)""",
)


def _paired(spark, sf):
    """Sample by sample, each recording against half of itself mixed with another."""
    long_ = frames(spark, sf).select("file", "col", F.posexplode("x").alias("i", "v")).select("file", (F.col("col") * 64 + F.col("i")).alias("pos"), "v")
    other = long_.select(F.col("file").alias("b"), "pos", F.col("v").alias("w"))
    return long_.withColumnRenamed("file", "a").join(other, "pos").filter("a < b").select("a", "b", "pos", F.col("v").alias("x"), (0.5 * F.col("v") + F.col("w")).alias("y"))


@query(sql("""
SELECT a, b, n, round(20 * log10(abs(gain) + 1e-12), 5) AS gain_db, round(corr, 6) AS correlation, round(depth, 5) AS residual_db, round(20 * log10(peak + 1e-12), 5) AS residual_peak_db,
  CASE WHEN corr < 0.5 THEN 'null.unrelated' WHEN depth < -60 THEN 'null.identical' WHEN depth < -18 THEN 'null.lossy' WHEN depth < -8 THEN 'null.mastering' ELSE 'null.distant' END AS verdict_key,
  CASE WHEN corr >= 0.5 AND depth < -18 THEN 'ok' ELSE 'warn' END AS level FROM nulls""", *PAIRED))
def null_test(spark, sf):
    out = PR.null_test(_paired(spark, sf), "a", "b")
    return out.select("a", "b", "n", F.round("gain_db", 5).alias("gain_db"), r6("correlation").alias("correlation"), F.round("residual_db", 5).alias("residual_db"), F.round("residual_peak_db", 5).alias("residual_peak_db"), "verdict_key", "level")


@query(sql("""
SELECT a, b, round(avg(er - ea) FILTER (r <= k), 6) AS quiet_rel_db, round(avg(er - ea) FILTER (r > m - k), 6) AS loud_rel_db FROM (
  SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY ea, frame) AS r, count(*) OVER (PARTITION BY a, b) AS m, greatest(1, count(*) OVER (PARTITION BY a, b) // 3) AS k FROM (
    SELECT a, b, pos // 64 AS frame, round(10 * log10(sum(x * x * (1 + (pos % 7))) + 1e-30), 9) AS ea, round(10 * log10(sum((x - y) * (x - y)) + 1e-30), 9) AS er FROM paired GROUP BY 1, 2, 3)) GROUP BY a, b""", *PAIRED))
def residual_terciles(spark, sf):
    energy = _paired(spark, sf).groupBy("a", "b", F.floor(F.col("pos") / 64).alias("frame")).agg(
        F.round(S.power_db(F.sum(F.col("x") * F.col("x") * (1 + F.col("pos") % 7))), 9).alias("ea"), F.round(S.power_db(F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y")))), 9).alias("er"))
    return PR.terciles(energy, "a", "b").select("a", "b", r6("quiet_rel_db").alias("quiet_rel_db"), r6("loud_rel_db").alias("loud_rel_db"))


@query(sql("SELECT x.file AS a, y.file AS b, round(coalesce(corr(10 * log10(x.power + 1e-30), 10 * log10(y.power + 1e-30)), 0), 6) AS shape_correlation FROM medians x JOIN medians y ON x.bin = y.bin AND x.file < y.file GROUP BY 1, 2"))
def shape_correlation(spark, sf):
    db = _db(spark, sf)
    both = db.select(F.col("file").alias("a"), "bin", F.col("db").alias("sa")).join(db.select(F.col("file").alias("b"), "bin", F.col("db").alias("sb")), "bin").filter("a < b")
    return PR.shape_correlation(both, "a", "b").withColumn("shape_correlation", r6("shape_correlation"))


@query("""
SELECT quiet, loud, shape, gap, CASE WHEN gap <= 20 AND (coalesce(loud > -12, false) OR coalesce(shape > 0.8 AND (loud IS NULL OR loud > -20), false)) THEN 'warn' ELSE 'ok' END AS level,
  CASE WHEN gap > 20 THEN 'res.impulses' ELSE coalesce(nullif(concat_ws(' ', CASE WHEN quiet > -6 THEN 'res.gate' END, CASE WHEN loud IS NOT NULL THEN 'res.loud' END,
    CASE WHEN shape > 0.8 AND (loud IS NULL OR loud > -20) THEN 'res.follows' WHEN shape < 0.5 THEN 'res.noise' END), ''), 'res.mixed') END AS keys
FROM (SELECT unnest([-3.0, -10.0, NULL])::DOUBLE AS quiet), (SELECT unnest([-8.0, -15.0, -30.0, NULL])::DOUBLE AS loud), (SELECT unnest([0.9, 0.6, 0.2, NULL])::DOUBLE AS shape), (SELECT unnest([5.0, 25.0])::DOUBLE AS gap)""")
def residual_verdicts(spark, sf):
    """The decision table of the residual over a grid of its inputs."""
    grid = spark.range(1)
    for name, values in (("quiet", [-3.0, -10.0, None]), ("loud", [-8.0, -15.0, -30.0, None]), ("shape", [0.9, 0.6, 0.2, None]), ("gap", [5.0, 25.0])):
        grid = grid.withColumn(name, F.explode(F.array(*(F.lit(v).cast("double") for v in values))))
    level, keys = PR.residual_verdict(F.col("gap"), F.col("quiet"), F.col("loud"), F.col("shape"))
    return grid.select("quiet", "loud", "shape", "gap", level.alias("level"), F.array_join(keys, " ").alias("keys"))


@query("""
SELECT scale, CAST(row AS INTEGER) AS row, round(CASE scale WHEN 'linear' THEN 50 + row / 31.0::DOUBLE * 5950 WHEN 'log' THEN 50 * pow(120.0::DOUBLE, row / 31.0::DOUBLE)
  ELSE 700 * (pow(10.0::DOUBLE, (2595 * log10(1 + 50 / 700.0::DOUBLE) + row / 31.0::DOUBLE * (2595 * log10(1 + 6000 / 700.0::DOUBLE) - 2595 * log10(1 + 50 / 700.0::DOUBLE))) / 2595) - 1) END, 6) AS hz
FROM (SELECT unnest(['linear', 'log', 'mel']) AS scale), (SELECT unnest(generate_series(0, 31)) AS row)""")
def mel_axis(spark, sf):
    """Row frequencies of the three axes."""
    rows = [spark.range(32).select(F.lit(s).alias("scale"), F.col("id").cast("int").alias("row"), r6(S.axis_hz(s, 50.0, 6000.0, 32, F.col("id"))).alias("hz")) for s in ("linear", "log", "mel")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


AXIS = """axis AS (SELECT row, least(greatest(50 * pow(120.0::DOUBLE, row / 31.0::DOUBLE) / 100, 0), 62.999999) AS idx FROM (SELECT unnest(generate_series(0, 31)) AS row))"""


@query(sql("""
SELECT file, CAST(row AS BIGINT) AS row, round(CASE WHEN up - lo >= 2 THEN max(db) FILTER (bin >= ceil(lo) AND bin < ceil(up)) ELSE
  sum(CASE WHEN bin = floor(idx) THEN db * (1 - (idx - floor(idx))) WHEN bin = floor(idx) + 1 THEN db * (idx - floor(idx)) END) END, 6) AS db
FROM (SELECT row, idx, coalesce((idx + lag(idx) OVER (ORDER BY row)) / 2, idx) AS lo, coalesce((idx + lead(idx) OVER (ORDER BY row)) / 2, idx) AS up FROM axis), reldb GROUP BY file, row, lo, up""", AXIS))
def remap_axis(spark, sf):
    """Spectra on 32 rows of a logarithmic axis."""
    db = SP.relative_db(SP.median_power(spectra(spark, sf))).select("file", F.posexplode("db").alias("bin", "db"))
    axis = spark.range(32).select(F.col("id").alias("row"), S.axis_hz("log", 50.0, 6000.0, 32, F.col("id")).alias("hz"))
    return PR.remapped_rows(db, axis, DF, 64, "file").withColumn("db", r6("db"))


@query(sql("""
SELECT file, CAST(t AS BIGINT) AS col, round(sum(CASE WHEN e.col = floor(a) THEN v * (1 - (a - floor(a))) ELSE v * (a - floor(a)) END), 6) AS db
FROM (SELECT file, t, least(t * ((n - 1.000001::DOUBLE) / 15), n - 1.000001::DOUBLE) AS a FROM (SELECT file, count(*) AS n, unnest(generate_series(0, 15)) AS t FROM frames GROUP BY file))
JOIN (SELECT file, col, list_sum(list_transform(x, lambda v: v * v)) AS v FROM frames) e USING (file) WHERE e.col = floor(a) OR e.col = floor(a) + 1 GROUP BY 1, 2"""))
def resample_columns(spark, sf):
    """All frames of each recording squeezed to 16 columns."""
    e = frames(spark, sf).select("file", "col", F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v).alias("db"))
    return PR.resampled_columns(e, 16, "file").withColumn("db", r6("db"))
