"""Queries over whole series as chunks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from undula.operators import series as SE
from undula.plans import hosting as H
from undula.plans.hosting import sql
from undula.sources import store, wav

QUERIES, ORACLE = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def rounded(name: str, digits: int = 6):
    """Rounded, and without a negative zero."""
    return (F.round(name, digits) + 0.0).alias(name)


CHUNK = 64


def vectors(spark, sf):
    """The vectors of a label one after the other, as chunks."""
    return H.frames(spark, sf).select("file", F.lit(0).alias("ch"), F.col("col").alias("chunk"), "x")


def levels(spark, sf, size: int = CHUNK):
    """The values of an event type in order of time, as chunks."""
    return SE.chunked(H.series(spark, sf).select("file", F.lit(0).alias("ch"), F.col("frame").alias("pos"), "x"), size)


@query(sql("""
SELECT up, down, file, m AS pos, round(sum(v * CASE WHEN abs(d) < 24 THEN least(1, up / down::DOUBLE) * CASE WHEN d = 0 THEN 1 ELSE sin(pi() * d / 3.0::DOUBLE) / (pi() * d / 3.0::DOUBLE) END * (0.5 + 0.5 * cos(pi() * d / 24.0::DOUBLE)) ELSE 0 END), 6) + 0.0 AS x
FROM (SELECT *, m * down - pos * up AS d FROM (SELECT up, down, file, m, unnest(generate_series((m * down) // up - 13, (m * down) // up + 13)) AS pos
  FROM (SELECT up, down, file, unnest(range((n * up + down - 1) // down)) AS m FROM (SELECT file, count(*) AS n FROM long_ GROUP BY file), (VALUES (2, 3), (3, 2)) r(up, down))) JOIN long_ USING (file, pos))
GROUP BY up, down, file, m""", "long_ AS (SELECT file, col * 64 + i AS pos, v FROM (SELECT file, col, unnest(generate_series(0, 63)) AS i, unnest(x) AS v FROM frames))"))
def resampled_rates(spark, sf):
    """Each recording at two thirds and at three halves of its rate, sample by sample."""

    def at(up: int, down: int):
        pieces = SE.resampled(vectors(spark, sf), up, down, CHUNK)
        samples = pieces.select("file", "first", F.posexplode("x").alias("k", "x"))
        return samples.select(F.lit(up).alias("up"), F.lit(down).alias("down"), "file", (F.col("first") + F.col("k")).alias("pos"), rounded("x"))

    return at(2, 3).unionByName(at(3, 2))


BINS = (
    "lengths AS (SELECT file, (max(frame) // 64 + 1) * 64 AS n FROM series GROUP BY file)",
    """bins AS MATERIALIZED (SELECT file, n, k, sum(x * cos(2 * pi() * ((k * frame) % n) / n)) AS re, -sum(x * sin(2 * pi() * ((k * frame) % n) / n)) AS im
  FROM (SELECT file, n, unnest(range(n)) AS k FROM lengths) JOIN series USING (file) GROUP BY file, n, k)""",
)


@query(sql("SELECT file, k AS bin, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM bins", *BINS))
def whole_bins(spark, sf):
    """The Fourier transform of the whole series of each event type."""
    c = levels(spark, sf)
    return SE.bins_of_spectrum(SE.whole_spectrum(c, CHUNK, block=SE.columns_each(c, CHUNK))).select("file", "bin", rounded("re"), rounded("im"))


@query(sql("""
SELECT file, pos, round(sum(re * cos(2 * pi() * ((k * pos) % n) / n) - im * sin(2 * pi() * ((k * pos) % n) / n)) / n, 6) + 0.0 AS x
FROM (SELECT file, n, unnest(range(n)) AS pos FROM lengths) JOIN bins USING (file, n) WHERE least(k, n - k) / n::DOUBLE BETWEEN 0.04 AND 0.09 GROUP BY file, n, pos""", *BINS))
def band_passed(spark, sf):
    """The part between two frequencies of the series of each event type, without delay."""
    out = SE.band_passed(levels(spark, sf), CHUNK, 0.04, 0.09).select("file", "chunk", F.posexplode("x").alias("k", "x"))
    return out.select("file", (F.col("chunk") * CHUNK + F.col("k")).alias("pos"), rounded("x"))


@query(sql("""
SELECT file, pos, round(sum(CASE WHEN last IS NULL THEN p ELSE p - last - 2 * pi() * floor((p - last + pi()) / (2 * pi())) END) OVER (PARTITION BY file ORDER BY pos), 6) + 0.0 AS phase
FROM (SELECT *, lag(p) OVER (PARTITION BY file ORDER BY pos) AS last FROM (
  SELECT file, pos, atan2(sum(re * sin(2 * pi() * ((k * pos) % n) / n) + im * cos(2 * pi() * ((k * pos) % n) / n)), sum(re * cos(2 * pi() * ((k * pos) % n) / n) - im * sin(2 * pi() * ((k * pos) % n) / n))) AS p
  FROM (SELECT file, n, unnest(range(n)) AS pos FROM lengths) JOIN bins USING (file, n) WHERE k / n::DOUBLE BETWEEN 0.1 AND 0.12 GROUP BY file, n, pos))""", *BINS))
def unwrapped_phase(spark, sf):
    """The phase of the analytic signal of each event type within a band, without jumps."""
    out = SE.unwrapped_phase(SE.analytic(levels(spark, sf), CHUNK, 0.1, 0.12)).select("file", "chunk", F.posexplode("x").alias("k", "phase"))
    return out.select("file", (F.col("chunk") * CHUNK + F.col("k")).alias("pos"), rounded("phase"))


MOST = 256


@query(sql(f"""
SELECT a, b, arg_min(lag, (-abs(product), lag)) AS lag, round(arg_min(product, (-abs(product), lag)), 3) + 0.0 AS product FROM (
  SELECT x.file AS a, y.file AS b, lag, sum(x.v * y.v) AS product
  FROM (SELECT *, frame + lag AS there FROM free, (SELECT unnest(generate_series(-{MOST}, {MOST})) AS lag)) y JOIN free x ON x.k = y.k - 1 AND x.frame = there GROUP BY 1, 2, 3) GROUP BY a, b""",
  "free AS (SELECT file, frame, x - avg(x) OVER (PARTITION BY file) AS v, dense_rank() OVER (ORDER BY file) AS k FROM series)"))
def whole_lag(spark, sf):
    """The strongest lag of each event type against the next one, over their whole series."""
    c = levels(spark, sf)
    x, y = H.neighbours(c)
    sides = (df.select(F.col("a").alias("file"), F.col("b").alias("ch"), "chunk", "x") for df in (x, y))
    return SE.strongest_lags(*sides, CHUNK, MOST, section=1024).select(F.col("file").alias("a"), F.col("ch").alias("b"), "lag", rounded("product", 3))


#: Coefficients with many digits, so that no result lies on a border of rounding.
SECTION = (0.213471318437, 0.317331927311, 0.102913377529, -1.503711298371, 0.653191947117)
_B0, _B1, _B2, _A1, _A2 = (f"({c!r}::DOUBLE)" for c in SECTION)


@query("WITH RECURSIVE " + sql("""
SELECT chunk, file, frame AS pos, round(y, 6) + 0.0 AS y FROM run, (VALUES (64), (1000)) c(chunk)""",
    f"""run AS (SELECT file, frame, {_B0} * x AS y, {_B1} * x - {_A1} * ({_B0} * x) AS s, {_B2} * x - {_A2} * ({_B0} * x) AS r FROM series WHERE frame = 0
  UNION ALL SELECT s.file, s.frame, {_B0} * s.x + p.s, {_B1} * s.x - {_A1} * ({_B0} * s.x + p.s) + p.r, {_B2} * s.x - {_A2} * ({_B0} * s.x + p.s) FROM run p JOIN series s ON s.file = p.file AND s.frame = p.frame + 1)""")[len("WITH "):].replace("series AS (", "series AS MATERIALIZED ("))
def recursive_levels(spark, sf):
    """The series of each event type through a recursive filter, by chunks of two lengths."""

    def by(size: int):
        out = SE.recursive_filter(levels(spark, sf, size), [SECTION], size).select("file", "chunk", F.posexplode("x").alias("k", "y"))
        return out.select(F.lit(size).alias("chunk"), "file", (F.col("chunk") * size + F.col("k")).alias("pos"), rounded("y"))

    return by(64).unionByName(by(1000))


@query(sql("SELECT file, col, round(list_sum(list_transform(x, lambda v: v)), 6) + 0.0 AS total, round(list_sum(list_transform(x, lambda v, i: v * i)), 6) + 0.0 AS moment FROM frames"))
def wav_round_trip(spark, sf):
    """The recordings written as WAV sound to the shared folder and read back by ranges of bytes: two sums of each frame."""
    folder = store.shared_folder(spark, "wav")
    wav.write_wav(vectors(spark, sf).withColumn("sr", F.lit(8000)), folder, CHUNK)
    read = wav.read_wav(spark, folder, chunk=CHUNK, split=CHUNK * 4 * 5)
    x = F.transform("x", lambda v: v.cast("double"))
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, v: s + v), 6) + 0.0
    return read.select(F.col("file").cast("int").alias("file"), F.col("chunk").alias("col"), total(x).alias("total"), total(F.transform(x, lambda v, i: v * (i + 1))).alias("moment"))
