"""Queries over event series and levels, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from undula.operators import events as EV
from undula.operators import levels as LV
from undula.plans.hosting import neighbours, series, sql, table

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


@query("""
SELECT event_type, CAST(epoch_us(s) AS BIGINT) AS start_us, count(*) AS n, round(sum(value), 6) AS total
FROM events, (SELECT unnest([0, 1, 2]) AS k) o, LATERAL (SELECT time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 2 HOUR * k AS s) GROUP BY 1, 2""")
def hop_windows(spark, sf):
    """Six-hour windows every two hours."""
    return EV.hop_windows(table(spark, sf, "events"), "ts", "6 hours", "2 hours", "event_type").withColumn("total", r6("total"))


@query("SELECT event_type, CAST(epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start_us, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def tumble_windows(spark, sf):
    return EV.tumble_windows(table(spark, sf, "events"), "ts", "1 hour", "event_type").withColumn("total", r6("total"))


@query("""
SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, CAST(epoch_us(max(ts)) + 21600000000 AS BIGINT) AS end_us, count(*) AS n, round(sum(value), 6) AS total FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM (
    SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR >= ts THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, run""")
def session_runs(spark, sf):
    return EV.session_runs(table(spark, sf, "events"), "ts", "6 hours", "user_id").withColumn("total", r6("total"))


BASE_CTES = (
    "sized AS (SELECT file, greatest(1, count(*) // 50) AS nb FROM series GROUP BY file)",
    "blocks_ AS (SELECT file, frame // 50 AS b, median(x) AS m FROM series JOIN sized USING (file) WHERE frame // 50 < nb GROUP BY 1, 2)",
    """placed AS (SELECT s.*, nb, (frame - 25) / 50.0::DOUBLE AS p, CAST(least(greatest(floor((frame - 25) / 50.0::DOUBLE), 0), nb - 1) AS BIGINT) AS i FROM series s JOIN sized USING (file))""",
    """based AS (SELECT p.file, p.frame, p.x, a.m + least(greatest(p.p - p.i, 0.0::DOUBLE), 1.0::DOUBLE) * (c.m - a.m) AS base FROM placed p
       JOIN blocks_ a ON a.file = p.file AND a.b = p.i JOIN blocks_ c ON c.file = p.file AND c.b = least(p.i + 1, p.nb - 1))""",
)


@query(sql("SELECT file, frame, round(x - base, 6) AS excess FROM based", *BASE_CTES))
def background_excess(spark, sf):
    """Levels over the median of blocks of 50 frames, interpolated between block centres."""
    return EV.block_background(series(spark, sf), ["x"], 50).select("file", "frame", r6(F.col("x") - F.col("x_base")).alias("excess"))


@query(sql("""
SELECT file, min(frame) FILTER (frame >= start_) AS first, max(frame) AS last, max(frame) - min(start_) + 1 AS frames, round(max(over_) FILTER (frame >= start_), 6) AS peak FROM (
  SELECT *, min(CASE WHEN over_ >= 120 THEN frame END) OVER (PARTITION BY file, island) AS start_ FROM (
    SELECT *, sum(CASE WHEN over_ <= 60 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY frame) AS island FROM (SELECT file, frame, x - base AS over_ FROM based)) WHERE over_ > 60)
WHERE start_ IS NOT NULL GROUP BY file, island""", *BASE_CTES))
def hysteresis_events(spark, sf):
    over = EV.block_background(series(spark, sf), ["x"], 50).withColumn("over", F.col("x") - F.col("x_base"))
    return EV.hysteresis_events(over, "over", 120.0).select("file", "first", "last", "frames", r6("peak").alias("peak"))


@query(sql("""
SELECT file, run, min(frame) AS first, max(frame) AS last, count(*) AS frames, round(median(x), 6) AS median FROM (
  SELECT *, CAST(sum(start_) OVER (PARTITION BY file ORDER BY frame) AS BIGINT) AS run FROM (
    SELECT *, CASE WHEN abs(x - lag(x) OVER w) / greatest(lag(x) OVER w, 1.0::DOUBLE) < 0.25 THEN 0 ELSE 1 END AS start_ FROM series WINDOW w AS (PARTITION BY file ORDER BY frame)))
GROUP BY file, run HAVING count(*) >= 3"""))
def stable_runs(spark, sf):
    return EV.stable_runs(series(spark, sf), "x", 0.25, least=3).withColumn("median", r6("median"))


@query("""
SELECT CAST(a.event_id AS BIGINT) AS event_id, a.user_id, round(a.value, 6) AS value, round(b.value, 6) AS last_view
FROM (SELECT * FROM events WHERE event_type = (SELECT max(event_type) FROM events)) a
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = (SELECT min(event_type) FROM events)) b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def asof_background(spark, sf):
    """Each event of one type with the user's last event of another type."""
    e = table(spark, sf, "events")
    kinds = e.agg(F.max("event_type"), F.min("event_type")).first()
    left = e.filter(F.col("event_type") == kinds[0]).select("user_id", "ts", "event_id", "value")
    right = e.filter(F.col("event_type") == kinds[1]).select("user_id", "ts", F.col("value").alias("last_view"))
    return EV.asof(left, right, "user_id", "ts", ["last_view"]).select("event_id", "user_id", r6("value").alias("value"), r6("last_view").alias("last_view"))


def _loud(spark, sf):
    """Values scaled to a peak of one."""
    return series(spark, sf).select("file", F.col("frame").alias("pos"), (F.col("x") / 490.0).alias("x"))


LEVEL_CTES = (
    "samples AS (SELECT file, frame AS pos, x / 490.0::DOUBLE AS x FROM series)",
    """levels AS (SELECT file, max(abs(x)) AS peak, sqrt(avg(x * x)) AS rms, avg(x) AS dc, count(*) AS n FROM samples GROUP BY file)""",
    """stats AS (SELECT l.*, 20 * log10(peak + 1e-12) AS peak_db, 20 * log10(rms + 1e-12) AS rms_db, (SELECT count(*) FROM samples s WHERE s.file = l.file AND abs(s.x) = l.peak) AS hits FROM levels l)""",
)


@query(sql("SELECT file, round(peak_db, 6) AS peak_dbfs, round(rms_db, 6) AS rms_dbfs, round_even(peak_db - rms_db, 2) AS crest_db, round(dc, 6) AS dc_offset, n AS samples, hits AS abs_peak_count FROM stats", *LEVEL_CTES))
def level_stats(spark, sf):
    out = LV.level_stats(_loud(spark, sf), "file")
    return out.select("file", r6("peak_dbfs").alias("peak_dbfs"), r6("rms_dbfs").alias("rms_dbfs"), "crest_db", r6("dc_offset").alias("dc_offset"), "samples", "abs_peak_count")


@query(sql("""
SELECT file, max(n) AS longest_flat, count(*) FILTER (n >= 2) AS flat_runs FROM (
  SELECT file, run, count(*) AS n FROM (SELECT *, sum(CASE WHEN top AND ok THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY pos) AS run FROM (
    SELECT file, pos, floor(x * 10) = max(floor(x * 10)) OVER (PARTITION BY file) AS top, lag(floor(x * 10)) OVER (PARTITION BY file ORDER BY pos) = floor(x * 10) AS ok FROM samples)) WHERE top GROUP BY 1, 2) GROUP BY file""", *LEVEL_CTES))
def flat_runs(spark, sf):
    """Runs at the top of levels cut to tenths."""
    return LV.flat_runs(_loud(spark, sf).withColumn("x", F.floor(F.col("x") * 10).cast("double")), "file")


@query(sql("""
SELECT file, hits AS abs_peak_count, round_even(hits / 5.0::DOUBLE, 1) AS rate_per_min, CASE WHEN peak_db > -1.0 AND hits / 5.0::DOUBLE >= 30 THEN 'clip.clipped' WHEN peak_db + 0.2 > -0.1 THEN 'clip.truepeak' END AS clip_key,
  CASE WHEN (peak_db > -1.0 AND hits / 5.0::DOUBLE >= 30) OR peak_db + 0.2 > -0.1 THEN 'warn' END AS clip_level FROM stats""", *LEVEL_CTES))
def clipping_verdict(spark, sf):
    levels = LV.level_stats(_loud(spark, sf), "file").withColumn("true_peak_dbfs", F.col("peak_dbfs") + 0.2).withColumn("flat_factor", F.lit(0.0))
    return LV.clipping_verdict(levels, F.lit(300.0)).select("file", "abs_peak_count", "rate_per_min", "clip_key", "clip_level")


@query(sql("SELECT file, CASE WHEN round_even(peak_db - rms_db, 2) < 12.5 AND rms_db - 0.7 > -12 THEN 'dyn.compressed' END AS dyn_key FROM stats", *LEVEL_CTES))
def dynamics_note(spark, sf):
    levels = LV.level_stats(_loud(spark, sf), "file").withColumn("lufs_integrated", F.col("rms_dbfs") - 0.7)
    return LV.dynamics_note(levels).select("file", "dyn_key")


@query("""
WITH hours AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS h, sum(value) AS v FROM events GROUP BY 1, 2),
nexts AS (SELECT event_type AS a, lead(event_type) OVER (ORDER BY event_type) AS b FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL))
SELECT a, b, count(*) AS n, round(sum(l * r) / (sqrt(sum(l * l) * sum(r * r)) + 1e-12), 6) AS correlation,
  round(10 * log10((sum(pow((l - r) / 2, 2)) + 1e-12) / (sum(pow((l + r) / 2, 2)) + 1e-12)), 6) AS side_ratio_db, sum(pow((l - r) / 2, 2)) < 1e-9 * (sum(pow((l + r) / 2, 2)) + 1e-12) AS identical_channels
FROM (SELECT a, b, x.v AS l, y.v AS r FROM nexts JOIN hours x ON x.event_type = a JOIN hours y ON y.event_type = b AND y.h = x.h) GROUP BY a, b""")
def stereo_stats(spark, sf):
    """Each event type and the next one, summed by the hour, as the channels of one recording."""
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    hours = table(spark, sf, "events").filter("event_type IS NOT NULL").groupBy(F.col("event_type").alias("file"), hour.alias("h")).agg(F.sum("value").alias("v"))
    left, right = neighbours(hours)
    pairs = left.withColumnRenamed("v", "l").join(right.withColumnRenamed("v", "r"), ["a", "b", "h"])
    out = LV.stereo_stats(pairs, "a", "b")
    return out.select("a", "b", "n", r6("correlation").alias("correlation"), r6("side_ratio_db").alias("side_ratio_db"), "identical_channels")


@query("""
SELECT event_type, round(sqrt(coalesce(sum((p + np) / 2 * (nf - f)), 0)), 6) AS rms FROM (
  SELECT *, lead(p) OVER w AS np, lead(f) OVER w AS nf FROM (SELECT event_type, extract(hour FROM ts)::DOUBLE AS f, avg(value) AS p FROM events GROUP BY 1, 2)
  WHERE f >= 6 AND f < 18 WINDOW w AS (PARTITION BY event_type ORDER BY f)) GROUP BY 1""")
def trapezoid_band_rms(spark, sf):
    psd = table(spark, sf, "events").groupBy("event_type", F.hour("ts").cast("double").alias("f")).agg(F.avg("value").alias("p"))
    return LV.trapezoid_rms(psd, 6.0, 18.0, "event_type").withColumn("rms", r6("rms"))
