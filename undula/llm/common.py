"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most so many keys are told to all tasks at once.
MANY_KEYS = 500_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir``; only a local master may fall back to a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    context.setCheckpointDir(folder)


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_limit(rows: int, *, least: int = 256) -> int:
    """The number of rows beyond which a key is hot: of ``rows`` rows, fewer than MANY_KEYS keys can have more."""
    return max(least, rows // MANY_KEYS)


def join_split(rows: DataFrame, values: DataFrame, keys: list[str], *, how: str = "inner", total: int | None = None) -> DataFrame:
    """``rows`` joined with ``values`` (one row a key) on ``keys``, inner or left, without gathering a hot key's rows in one task.

    The values of hot keys, fewer than MANY_KEYS, are broadcast, so that those rows stay where they are; other keys are
    shuffled.  Rows with a null in a key match nothing.
    """
    limit = hot_limit(rows.count() if total is None else total)
    hot = checkpoint(rows.groupBy(*keys).count().filter(F.col("count") > limit).drop("count"))
    if hot.isEmpty():
        return rows.join(values, keys, how)
    known = rows.join(F.broadcast(hot.join(values, keys, how)), keys)
    others = rows.join(F.broadcast(hot), keys, "left_anti")
    return known.unionByName(others.join(values, keys, how))


def told(values: DataFrame) -> DataFrame:
    """``values`` marked to be broadcast if they are at most MANY_KEYS rows; beyond, they are joined by shuffle."""
    return F.broadcast(values) if values.count() <= MANY_KEYS else values
