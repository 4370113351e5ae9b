"""Progress of a running scan and its results, kept in tables that a replayed batch does not change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException


def progress(results: DataFrame, totals: DataFrame, *by: str) -> DataFrame:
    """(by, total, done, warnings, computed, cached, errors, state) as far as the results have come in; ``state`` is done when nothing is left.

    ``results`` (by, level, cached, error) is a stream or a table, ``totals`` (by, total) a table of what was asked for.
    Counts are aggregates, which Spark adds up before the shuffle, so one collection with most of the results is no hot key, and
    the state is a row for each collection.  Null keys count as one collection of their own.
    """
    counted = results.groupBy(*by).agg(
        F.count("*").alias("done"), F.count_if(F.col("level") == "warn").alias("warnings"), F.count_if(~F.col("cached") & F.col("error").isNull()).alias("computed"),
        F.count_if(F.col("cached")).alias("cached"), F.count_if(F.col("error").isNotNull()).alias("errors"),
    )
    named = totals.select(*(F.col(c).alias(f"_{c}") for c in by), "total")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    state = F.when(F.col("done") >= F.col("total"), "done").otherwise("running")
    return counted.join(named, same, "left").withColumn("state", state).select(*by, "total", "done", "warnings", "computed", "cached", "errors", "state")


def upsert(stream: DataFrame, folder: str, keys: list[str], *, order: Column | None = None, mode: str = "append") -> StreamingQuery:
    """Run what is there now into the table of ``folder``: each batch replaces what was written under its number, so replaying one changes nothing.

    Of several rows of one key in a batch the one of the largest ``order`` counts (if that is equal or not given, the largest row).
    The stream's own state lies in ``folder`` too: after a stop, the same call goes on where it was.
    """

    def keep(batch: DataFrame, number: int) -> None:
        values = [c for c in batch.columns if c not in keys]
        rank = F.struct(*([order.alias("_order")] if order is not None else []), *values)
        last = batch.groupBy(*keys).agg(F.max(rank).alias("_v"))
        last.select(*keys, *(F.col(f"_v.{c}").alias(c) for c in values)).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start()


def history(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All rows with the number of their ``batch``; empty before the first one."""
    try:
        return spark.read.schema(f"{schema}, batch long").option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")
    except AnalysisException:
        return spark.createDataFrame([], f"{schema}, batch long")


def current(spark: SparkSession, folder: str, keys: list[str], schema: str) -> DataFrame:
    """The row of each key from its latest batch."""
    rows = history(spark, folder, schema)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return latest.select(*keys, *(F.col(f"_v.{c}").alias(c) for c in values))


def compacted(spark: SparkSession, folder: str, keys: list[str], schema: str, target: str) -> str:
    """Write the current rows as the first batch of a new folder and return it; readers of the old one are not disturbed."""
    current(spark, folder, keys, schema).write.mode("overwrite").parquet(f"{target}/rows/batch=-1")
    return target


def done_counts(results: DataFrame, by: str, order: str, *, span: Column) -> DataFrame:
    """Add ``done``: how many results of the collection there are up to and with each, in arrival ``order`` (unique in a collection).

    ``span`` rises with ``order``: rows are numbered within spans and spans by their counts, so no collection is sorted in one task.
    """
    rows = results.withColumn("_span", span)
    counts = rows.groupBy(by, "_span").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(by).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = counts.select(F.col(by).alias("_by"), F.col("_span").alias("_of"), before.alias("_base"))
    within = F.row_number().over(W.partitionBy(by, "_span").orderBy(order))
    joined = rows.withColumn("_k", within).join(base, F.col(by).eqNullSafe(F.col("_by")) & F.col("_span").eqNullSafe(F.col("_of")))
    return joined.withColumn("done", F.col("_base") + F.col("_k")).drop("_span", "_k", "_by", "_of", "_base")
