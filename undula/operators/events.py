"""Events in series of levels: background, hysteresis, runs, sessions, windows over time.

Running counts are taken in two steps, within spans of a series and then over
the spans, so a long series is not sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPAN = 65_536


def running_sum(df: DataFrame, amount: Column, name: str, *, file: str = "file", order: str = "frame", span: int = SPAN) -> DataFrame:
    """Add the running sum of ``amount`` up to and with each row of a series numbered by ``order``."""
    df = df.withColumn("_span", F.floor(F.col(order) / span)).withColumn("_amount", amount)
    base = df.groupBy(file, "_span").agg(F.sum("_amount").alias("_all"))
    base = base.select(file, "_span", F.coalesce(F.sum("_all").over(W.partitionBy(file).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    within = W.partitionBy(file, "_span").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.join(base, [file, "_span"]).withColumn(name, F.col("_base") + F.sum("_amount").over(within)).drop("_span", "_amount", "_base")


def block_background(df: DataFrame, values: list[str], block: int, *, file: str = "file", order: str = "frame") -> DataFrame:
    """Add ``<value>_base``: block medians, interpolated between block centres and held beyond them.

    Blocks are whole runs of ``block`` frames; what is left at the end takes no part (a series of less than one block is one block).
    """
    n = df.groupBy(file).agg((F.max(order) + 1).alias("_n"))
    df = df.join(n, file).withColumn("_nb", F.greatest(F.lit(1), F.floor(F.col("_n") / block)))
    mid = block // 2
    blocks = df.withColumn("_b", F.floor(F.col(order) / block)).filter(F.col("_b") < F.col("_nb")).groupBy(file, "_b").agg(*(F.percentile(v, 0.5).alias(f"_{v}") for v in values))
    place = (F.col(order) - mid) / F.lit(float(block))
    last = F.col("_nb") - 1
    df = df.withColumn("_i", F.least(F.greatest(F.floor(place), F.lit(0)), last)).withColumn("_j", F.least(F.col("_i") + 1, last)).withColumn("_t", F.least(F.greatest(place - F.col("_i"), F.lit(0.0)), F.lit(1.0)))
    a = blocks.select(file, F.col("_b").alias("_i"), *(F.col(f"_{v}").alias(f"_{v}_a") for v in values))
    b = blocks.select(file, F.col("_b").alias("_j"), *(F.col(f"_{v}").alias(f"_{v}_b") for v in values))
    df = df.join(a, [file, "_i"]).join(b, [file, "_j"])
    for v in values:
        df = df.withColumn(f"{v}_base", F.col(f"_{v}_a") + F.col("_t") * (F.col(f"_{v}_b") - F.col(f"_{v}_a")))
    return df.drop("_n", "_nb", "_i", "_j", "_t", *(f"_{v}_{s}" for v in values for s in "ab"))


def hysteresis_events(df: DataFrame, over: str, threshold: float, *, companions: tuple[str, ...] = (), file: str = "file", order: str = "frame") -> DataFrame:
    """Events begin at ``threshold`` and end before the first frame at or below half of it.

    (file, first, last, frames, peak, peak_<companion>).  Quiet frames part the series into islands; an island holds one event at most.
    """
    quiet = F.when(F.col(over) <= threshold / 2, 1).otherwise(0)
    hot = F.when(F.col(over) >= threshold, F.col(order))
    isles = running_sum(df, quiet, "island", file=file, order=order).filter(F.col(over) > threshold / 2)
    first = isles.groupBy(file, "island").agg(F.min(hot).alias("first")).filter("first IS NOT NULL")
    inside = isles.join(first, [file, "island"]).filter(F.col(order) >= F.col("first"))
    events = inside.groupBy(file, "island", "first").agg(F.max(order).alias("last"), F.max(over).alias("peak"), *(F.max(c).alias(f"peak_{c}") for c in companions))
    return events.withColumn("frames", F.col("last") - F.col("first") + 1).drop("island")


def stable_runs(df: DataFrame, value: str, tolerance: float, *, also: tuple[str, ...] = (), file: str = "file", order: str = "frame", least: int = 1) -> DataFrame:
    """Runs in which each value is within a relative ``tolerance`` of the one before; nulls part runs.

    (file, run, first, last, frames, median, and the medians of the columns ``also``)
    """
    # the value before comes by a join on the frame's number, and runs are counted in spans: no series is sorted in one task
    last = df.select(file, (F.col(order) + 1).alias(order), F.col(value).alias("_before"))
    joined = df.join(last, [file, order], "left")
    near = F.abs(F.col(value) - F.col("_before")) / F.greatest(F.col("_before"), F.lit(1.0)) < tolerance
    starts = F.when(F.col(value).isNull() | F.coalesce(near, F.lit(False)), 0).otherwise(1)
    marked = running_sum(joined, starts, "run", file=file, order=order).filter(F.col(value).isNotNull())
    runs = marked.groupBy(file, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("frames"), F.percentile(value, 0.5).alias("median"), *(F.percentile(c, 0.5).alias(c) for c in also))
    return runs.filter(F.col("frames") >= least)


def hop_windows(events: DataFrame, ts: str, length: str, hop: str, *by: str, value: str = "value") -> DataFrame:
    w = F.window(F.col(ts).cast("timestamp"), length, hop)
    return events.groupBy(*by, w.alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(*by, F.unix_micros("w.start").alias("start_us"), "n", "total")


def tumble_windows(events: DataFrame, ts: str, length: str, *by: str, value: str = "value") -> DataFrame:
    return hop_windows(events, ts, length, length, *by, value=value)


def session_runs(events: DataFrame, ts: str, gap: str, *by: str, value: str = "value") -> DataFrame:
    w = F.session_window(F.col(ts).cast("timestamp"), gap)
    return events.groupBy(*by, w.alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(*by, F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n", "total")


def asof(left: DataFrame, right: DataFrame, by: str, ts: str, values: list[str], *, bucket_us: int = 86_400_000_000) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before it; null if there is none.

    Both sides are merged and sorted within (key, time bucket); the last row of
    earlier buckets comes by a window over one row for each bucket.  So a hot key
    is spread over its buckets.
    """
    cols = [c for c in left.columns if c not in (by, ts)]
    payload = F.struct(*values)
    both = left.select(by, ts, F.lit(1).alias("_side"), F.struct(*cols).alias("_row"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_p"))
    both = both.unionByName(right.select(by, ts, F.lit(0).alias("_side"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), payload.alias("_p")))
    both = both.withColumn("_bucket", F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / bucket_us))
    final = both.filter("_side = 0").groupBy(by, "_bucket").agg(F.max_by("_p", F.col(ts)).alias("_last"))
    every = both.select(by, "_bucket").distinct().join(final, [by, "_bucket"], "left")
    carried = every.select(by, "_bucket", F.last("_last", ignorenulls=True).over(W.partitionBy(by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)).alias("_carried"))
    w = W.partitionBy(by, "_bucket").orderBy(ts, "_side").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("_own", F.last("_p", ignorenulls=True).over(w)).filter("_side = 1").join(carried, [by, "_bucket"])
    hit = F.coalesce("_own", "_carried")
    return found.select(by, ts, "_row.*", *(hit[v].alias(v) for v in values))
