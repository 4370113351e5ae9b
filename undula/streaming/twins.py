"""Streaming variants: the same windows and pools over unbounded input, with state bounded by watermarks.

``collected`` runs a query over what is there now and returns the latest row for
each key, so results can be compared with the batch operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.sources.store import shared_folder

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events_stream(spark: SparkSession, folder: str, *, late: str = "1 day", files: int = 100) -> DataFrame:
    """Event files of a folder as they come in; event time is read as UTC."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", files).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, length: str, *by: str, hop: str | None = None) -> DataFrame:
    w = F.window("ts", length, hop or length)
    return events.groupBy(*by, w.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(*by, F.unix_micros("w.start").alias("start_us"), "n", "total")


def sessions(events: DataFrame, gap: str, *by: str) -> DataFrame:
    w = F.session_window("ts", gap)
    return events.groupBy(*by, w.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(*by, F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n", "total")


def running_pool(events: DataFrame, by: str, max_cols: int) -> DataFrame:
    """(by, col, mag): the series of each key pooled by its largest values to less than 2 * max_cols columns.

    The state is the pool alone: it is halved whenever it is full, so it stays bounded however long the series gets.
    """

    def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, factor, pool = state.get if state.exists else (0, 1, [])
        pool = list(pool)
        new = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for value in new["value"]:
            if n // factor == len(pool):
                pool.append(float(value))
            else:
                pool[-1] = max(pool[-1], float(value))
            n += 1
            if n // factor >= 2 * max_cols:
                pool = [max(pool[k : k + 2]) for k in range(0, len(pool), 2)]
                factor *= 2
        state.update((n, factor, pool))
        yield pd.DataFrame({by: key[0], "col": range(len(pool)), "mag": pool, "factor": factor})

    from pyspark.sql.streaming.state import GroupStateTimeout

    rows = events.select(by, "ts", "event_id", "value")
    return rows.groupBy(by).applyInPandasWithState(update, f"{by} string, col long, mag double, factor long", "n long, factor long, pool array<double>", "update", GroupStateTimeout.NoTimeout)


def collected(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Run over the input that is there now, each micro-batch appended to a table in the shared folder; the latest row of each key."""
    spark = stream.sparkSession
    folder = shared_folder(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(f"{folder}/rows")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows")
    values = [c for c in rows.columns if c not in (*keys, "_batch")]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("v"))
    return latest.select(*keys, "v.*")
