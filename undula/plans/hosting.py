"""How the measurements are hosted on the driver's tables.

``embeddings``: a label is a recording, its vectors in order of vec_id are frames of
64 samples, and their absolute values are magnitude spectra of 64 bins.
``events``: an event type is a channel, its events in order of time are frames, and
the value is a level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undula.operators.frames import bins_of, numbered
from undula.operators.sized import small

#: The sampling rate that 64 bins are read at: nfft 126, 100 Hz a bin.
NFFT, RATE, DF = 126, 12600, 100.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    return numbered(table(spark, sf_dir, "embeddings"), "label", "vec_id", x, span=F.floor(F.col("vec_id") / 65_536))


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bins_of(frames(spark, sf_dir).withColumn("mags", F.transform("x", F.abs)))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(table(spark, sf_dir, "events"), "event_type", "ts", F.col("value"), span=F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000)).withColumnRenamed("col", "frame")


def neighbours(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` of each file as side ``a`` and as side ``b`` of the pairs (a, b) of a file and the next one there is."""
    # One narrow row a file.
    pairs = rows.select(F.col("file").alias("a")).distinct().withColumn("b", F.lead("a").over(W.orderBy("a"))).filter("b IS NOT NULL")
    return tuple(rows.join(small(pairs.withColumn("file", F.col(side))), "file").drop("file") for side in ("a", "b"))


#: The same in DuckDB SQL.
SQL = """
frames AS (SELECT label AS file, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS col, embedding::DOUBLE[] AS x FROM embeddings),
spectra AS (SELECT file, col, unnest(generate_series(0, len(x) - 1)) AS bin, abs(unnest(x)) AS mag FROM frames),
series AS (SELECT event_type AS file, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS frame, value AS x FROM events),
medians AS (SELECT file, bin, median(mag * mag) AS power FROM spectra GROUP BY file, bin),
reldb AS (SELECT file, bin, 10 * log10(power + 1e-30) - max(10 * log10(power + 1e-30)) OVER (PARTITION BY file) AS db FROM medians)
"""


def sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([SQL.strip(), *(c.strip() for c in ctes)]) + "\n" + body.strip()
