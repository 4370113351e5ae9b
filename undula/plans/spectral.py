"""Queries over spectra, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undula.functions import arrays as A
from undula.functions import scalar as S
from undula.operators import frames as FR
from undula.operators import spectrum as SP
from undula.plans.hosting import DF, NFFT, RATE, frames, spectra, sql

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


@query(sql("""
SELECT file, col, round(db, 6) AS energy_db FROM (
  SELECT file, col, 10 * log10(list_sum(list_transform(x, lambda v: v * v)) + 1e-30) AS db,
    row_number() OVER (PARTITION BY file ORDER BY list_sum(list_transform(x, lambda v: v * abs(v))) DESC, col) AS rank FROM frames)
WHERE rank <= 5"""))
def frame_energy(spark, sf):
    """The five frames of each recording with the largest signed energy, and their energy in dB."""
    e = frames(spark, sf).withColumn("e", A.total(F.transform("x", lambda v: v * v))).withColumn("s", A.total(F.transform("x", lambda v: v * F.abs(v))))
    rank = F.row_number().over(W.partitionBy("file").orderBy(F.col("s").desc(), "col"))
    return e.withColumn("rank", rank).filter("rank <= 5").select("file", "col", r6(S.power_db(F.col("e"))).alias("energy_db"))


@query(sql("""
SELECT file, CAST(CASE WHEN bin < 1 THEN 0 WHEN bin < 2 THEN 2 WHEN bin < 5 THEN 3 WHEN bin < 10 THEN 4 WHEN bin < 20 THEN 5 WHEN bin < 40 THEN 6 ELSE 7 END AS INTEGER) AS band,
  round(sum(p) / (max(t) + 1e-12), 6) AS share
FROM (SELECT file, bin, avg(mag * mag) AS p, sum(avg(mag * mag)) OVER (PARTITION BY file) AS t FROM spectra GROUP BY file, bin) GROUP BY 1, 2"""))
def band_energy_share(spark, sf):
    edges = (0, 60, 120, 250, 500, 1000, 2000, 4000)
    return SP.band_shares(spectra(spark, sf), DF, RATE / 2, edges).select("file", F.when(F.col("band") == 1, 0).otherwise(F.col("band")).alias("band"), r6("share").alias("share"))


@query(sql("SELECT file, bin, round(10 * log10(power + 1e-30), 6) AS db FROM medians"))
def median_spectrum(spark, sf):
    return SP.median_power(spectra(spark, sf)).select("file", "bin", r6(S.power_db(F.col("power"))).alias("db"))


@query(sql("""
SELECT file, max(bin) * 100.0::DOUBLE AS cutoff_hz FROM (
  SELECT file, bin, 10 * log10(avg(mag * mag) + 1e-12) AS db, max(10 * log10(avg(mag * mag) + 1e-12)) OVER (PARTITION BY file) AS peak FROM spectra GROUP BY file, bin)
WHERE db > peak - 1.5 GROUP BY file"""))
def cutoff_bin(spark, sf):
    return SP.cutoff(spectra(spark, sf), DF, drop_db=1.5)


@query(sql("""
SELECT file, bin, round(sum(db) OVER (PARTITION BY file ORDER BY bin ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) / 6, 6) AS db FROM reldb"""))
def smoothed_spectrum(spark, sf):
    m = SP.median_power(spectra(spark, sf)).withColumn("p", S.power_db(F.col("power")))
    m = m.withColumn("db", F.col("p") - F.max("p").over(W.partitionBy("file")))
    return m.select("file", "bin", r6(SP.smoothed(m, "db", 6)).alias("db"))


@query(sql("SELECT file, round_even(max(bin) FILTER (db > -1.2) * 100.0::DOUBLE, 1) AS bandwidth_hz FROM reldb GROUP BY file"))
def signal_bandwidth(spark, sf):
    return SP.relative_db(SP.median_power(spectra(spark, sf))).select("file", SP.signal_bandwidth(F.col("db"), DF, 1.2).alias("bandwidth_hz"))


@query(sql("""
SELECT file, col, CAST(k AS INTEGER) AS bin, round(sqrt(pow(sum(v * cos(2 * pi() * k * i / 64)), 2) + pow(sum(v * sin(2 * pi() * k * i / 64)), 2)), 6) AS mag
FROM (SELECT file, col, unnest(generate_series(0, 63)) AS i, unnest(x) AS v FROM frames), (SELECT unnest(generate_series(0, 32)) AS k) GROUP BY 1, 2, 3"""))
def dft_magnitudes(spark, sf):
    found = frames(spark, sf).select("file", "col", F.posexplode(A.dft_magnitudes(F.col("x"), 64)).alias("bin", "mag"))
    return found.select("file", "col", "bin", r6("mag").alias("mag"))


@query("""
SELECT name, CAST(i AS INTEGER) AS i, round(CASE name WHEN 'hann' THEN 0.5 - 0.5 * cos(x) WHEN 'hamming' THEN 0.54 - 0.46 * cos(x)
  WHEN 'blackman' THEN 0.42 - 0.5 * cos(x) + 0.08 * cos(2 * x) WHEN 'bartlett' THEN 1 - abs(2.0 * i / 63 - 1) ELSE 1.0 END::DOUBLE, 6) + 0.0 AS value
FROM (SELECT unnest(['hann', 'hamming', 'blackman', 'bartlett', 'rect']) AS name), (SELECT i, 2 * pi() * i / 63 AS x FROM (SELECT unnest(generate_series(0, 63)) AS i))""")
def window_functions(spark, sf):
    i = F.col("id").cast("int")
    parts = [spark.range(64).select(F.lit(n).alias("name"), i.alias("i"), (r6(S.window_value(n, 64, F.col("id"))) + 0.0).alias("value")) for n in ("hann", "hamming", "blackman", "bartlett", "rect")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(sql("""
SELECT file, CAST(col // p AS BIGINT) AS col, bin, round(max(mag), 6) AS mag FROM (
  SELECT s.*, (SELECT min(1 << k) FROM (SELECT unnest(generate_series(0, 20)) AS k) WHERE n // (1 << k) < 16) AS p
  FROM spectra s JOIN (SELECT file, count(*) AS n FROM frames GROUP BY file) USING (file)) GROUP BY 1, 2, 3"""))
def column_max_pool(spark, sf):
    return FR.max_pool(spectra(spark, sf), 8).withColumn("mag", r6("mag"))


@query(sql("""
SELECT file, CAST(block AS BIGINT) AS block, bin, round(median(mag * mag), 9) AS power FROM (
  SELECT s.file, s.bin, s.mag, b.block FROM spectra s JOIN (SELECT file, col, ntile(5) OVER (PARTITION BY file ORDER BY col) - 1 AS block FROM frames) b USING (file, col)) GROUP BY 1, 2, 3"""))
def block_split_stats(spark, sf):
    rows = spectra(spark, sf)
    n = rows.groupBy("file").agg((F.max("col") + 1).alias("n"))
    blocked = rows.join(n, "file").withColumn("block", FR.block_of(F.col("col"), F.col("n"), F.lit(5)))
    return SP.median_power(blocked, "block").select("file", "block", "bin", F.round("power", 9).alias("power"))


EDGE = {"min_drop": 0.5, "min_hz": 1500.0, "min_steepness": 0.2, "below_hz": 900.0, "above_hz": (300.0, 1500.0)}
EDGE_CTES = (
    # candidates, their medians, the first largest drop, the steepest place near it
    """cand AS (SELECT i, greatest(4, i - 9) AS b0, i + 3 AS a0, least(i + 15, 63) AS a1 FROM (SELECT unnest(generate_series(15, 61)) AS i) WHERE least(i + 15, 63) - (i + 3) >= 3)""",
    """lower_ AS (SELECT file, i, median(db) AS m FROM cand JOIN reldb ON bin >= b0 AND bin < i GROUP BY 1, 2)""",
    """upper_ AS (SELECT file, i, median(db) AS m FROM cand JOIN reldb ON bin >= a0 AND bin < a1 GROUP BY 1, 2)""",
    """drops AS (SELECT file, i, l.m - u.m AS d, u.m AS floor_ FROM lower_ l JOIN upper_ u USING (file, i))""",
    """best AS (SELECT file, i AS ib, d, floor_ FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY d DESC, i) AS r FROM drops) WHERE r = 1 AND d >= 0.5)""",
    """slopes AS (SELECT b.file, b.ib, b.d, b.floor_, x.bin AS j, x.db - y.db AS g FROM best b JOIN reldb x ON x.file = b.file AND x.bin >= greatest(1, b.ib - 5) AND x.bin < least(62, b.ib + 40) - 2
       JOIN reldb y ON y.file = b.file AND y.bin = x.bin + 2)""",
    """steepest AS (SELECT file, d, floor_, j FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY g DESC, j) AS r FROM slopes) WHERE r = 1)""",
    """edges AS (SELECT s.file, s.j * 100.0::DOUBLE AS hz, round_even(s.d, 1) AS drop_db, round_even(s.floor_, 1) AS floor_db, (a.db - b.db) / ((b.bin - a.bin) * 0.1::DOUBLE) AS slope
       FROM steepest s JOIN reldb a ON a.file = s.file AND a.bin = greatest(1, s.j - 5) JOIN reldb b ON b.file = s.file AND b.bin = least(63, s.j + 5))""",
)


@query(sql("SELECT file, hz, drop_db, floor_db, round_even(slope, 1) AS steepness FROM edges WHERE slope >= 0.2", *EDGE_CTES))
def spectral_edge(spark, sf):
    db = SP.relative_db(SP.median_power(spectra(spark, sf)))
    return db.select("file", SP.spectral_edge(F.col("db"), DF, RATE / 2, **EDGE).alias("e")).filter("e IS NOT NULL").select("file", "e.*")


@query()
def band_pattern(spark, sf):
    """Edges by block, pattern and verdict; the codec of a recording is made up from its label."""
    rows = spectra(spark, sf)
    codecs = rows.select("file").distinct().select("file", F.when(F.col("file") % 2 == 0, "FLAC").otherwise("mp3").alias("codec"))
    return SP.band_analysis(rows, codecs, RATE, NFFT, **EDGE)


TONES = {"min_hz": 500.0, "min_prominence": 0.3, "min_share": 0.3, "level": (-95.0, 0.5), "blocks": 4, "limit": 6, "kernel_hz": 400.0, "width_hz": 6000.0, "raster_hz": 100.0, "per_block": 10, "least_cols": 24}


@query(sql("""
SELECT file, hz, prominence_db, level_db, share, CAST(row_number() OVER (PARTITION BY file ORDER BY prominence_db DESC, hz) AS INTEGER) AS rank FROM (
  SELECT file, round_even(median(bin * 100.0::DOUBLE), 1) AS hz, round_even(median(prom), 1) AS prominence_db, round_even(median(db - ref), 1) AS level_db, round_even(count(DISTINCT block) / 4.0::DOUBLE, 2) AS share
  FROM tones GROUP BY file, bin HAVING count(DISTINCT block) / 4.0::DOUBLE >= 0.3) QUALIFY rank <= 6""",
    "blocks_ AS (SELECT file, col, ntile(4) OVER (PARTITION BY file ORDER BY col) - 1 AS block FROM frames)",
    "med AS (SELECT file, block, bin, 10 * log10(median(mag * mag) + 1e-30) AS db FROM spectra JOIN blocks_ USING (file, col) GROUP BY 1, 2, 3)",
    "refd AS (SELECT *, max(db) OVER (PARTITION BY file, block) AS ref FROM med)",
    """seg AS (SELECT *, db - sum(db) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS prom, lag(db) OVER w AS before_, lead(db) OVER w AS after_
       FROM refd WHERE bin >= 5 AND bin < 61 WINDOW w AS (PARTITION BY file, block ORDER BY bin))""",
    "tones AS (SELECT * FROM seg WHERE prom > 0.3 AND db >= before_ AND db >= after_ AND db - ref <= 0.5 AND db - ref >= -95)"))
def tonal_peaks(spark, sf):
    return SP.tonal_peaks(spectra(spark, sf), RATE, NFFT, **TONES)


@query(sql("""
SELECT file, CAST(k AS INTEGER) AS harmonic, CAST(bin AS INTEGER) AS bin, round(prom, 6) AS prominence_db, round(db, 6) AS level_db FROM (
  SELECT d.*, h.k, row_number() OVER (PARTITION BY file, h.k ORDER BY db DESC, bin) AS r
  FROM (SELECT *, db - sum(db) OVER (PARTITION BY file ORDER BY bin ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7 AS prom FROM reldb) d
  JOIN (SELECT unnest(generate_series(1, 6)) AS k) h ON d.bin >= 9 * h.k - 3 AND d.bin <= 9 * h.k + 3) WHERE r = 1"""))
def harmonic_prominence(spark, sf):
    """The strongest bin within three of each multiple of bin 9, and how far it stands out."""
    m = SP.median_power(spectra(spark, sf)).withColumn("p", S.power_db(F.col("power"))).withColumn("db", F.col("p") - F.max("p").over(W.partitionBy("file")))
    m = m.withColumn("prom", F.col("db") - SP.smoothed(m, "db", 7))
    # each bin belongs to the multiples that it is near: an equi-key instead of a range join
    near = m.withColumn("harmonic", F.explode(F.filter(F.sequence(F.lit(1), F.lit(6)), lambda k: F.abs(F.col("bin") - 9 * k) <= 3)))
    best = near.groupBy("file", "harmonic").agg(F.max(F.struct("db", (-F.col("bin")).alias("b"), "prom")).alias("m"))
    return best.select("file", "harmonic", (-F.col("m.b")).cast("int").alias("bin"), r6("m.prom").alias("prominence_db"), r6("m.db").alias("level_db"))


@query(sql("""
SELECT file, CASE WHEN s9 >= s11 THEN 9 ELSE 11 END AS base_bin, round(s9, 6) AS score_9, round(s11, 6) AS score_11 FROM (
  SELECT file, sum(greatest(0.0::DOUBLE, prom)) FILTER (f = 9) AS s9, sum(greatest(0.0::DOUBLE, prom)) FILTER (f = 11) AS s11 FROM (
    SELECT d.*, h.f, row_number() OVER (PARTITION BY file, h.f, h.k ORDER BY db DESC, bin) AS r
    FROM (SELECT *, db - sum(db) OVER (PARTITION BY file ORDER BY bin ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7 AS prom FROM reldb) d
    JOIN (SELECT f, k FROM (SELECT unnest([9, 11]) AS f), (SELECT unnest(generate_series(1, 5)) AS k)) h ON d.bin >= h.f * h.k - 3 AND d.bin <= h.f * h.k + 3) WHERE r = 1 GROUP BY file)"""))
def hum_score(spark, sf):
    """Which of two base frequencies has the more prominent harmonics; the lower one on a tie."""
    m = SP.median_power(spectra(spark, sf)).withColumn("p", S.power_db(F.col("power"))).withColumn("db", F.col("p") - F.max("p").over(W.partitionBy("file")))
    m = m.withColumn("prom", F.col("db") - SP.smoothed(m, "db", 7))
    asked = F.array(*(F.struct(F.lit(f).alias("f"), F.lit(k).alias("k")) for f in (9, 11) for k in range(1, 6)))
    near = m.withColumn("h", F.explode(F.filter(asked, lambda h: F.abs(F.col("bin") - h["f"] * h["k"]) <= 3)))
    best = near.groupBy("file", "h").agg(F.max(F.struct("db", (-F.col("bin")).alias("b"), "prom")).alias("m"))
    score = lambda f: F.sum(F.when(F.col("h.f") == f, F.greatest(F.lit(0.0), F.col("m.prom"))))
    out = best.groupBy("file").agg(score(9).alias("a"), score(11).alias("b"))
    return out.select("file", F.when(F.col("a") >= F.col("b"), 9).otherwise(11).alias("base_bin"), r6("a").alias("score_9"), r6("b").alias("score_11"))
