"""Joins whose small side is broadcast only after its size is known, and tables that cut a lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most so many rows, each at most ROW_BYTES wide, is broadcast.
MOST_ROWS, ROW_BYTES = 200_000, 512


def small(df: DataFrame, *, most: int = MOST_ROWS) -> DataFrame:
    """``df``, whose rows are narrow, marked for broadcast if it has at most ``most`` rows; otherwise it is joined by shuffle, where Spark splits skewed keys."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def shared_base(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where a single local process does all the work."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="undula-")
    return base


def kept(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder and read from there."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint(eager=True)
