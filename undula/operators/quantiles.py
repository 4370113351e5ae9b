"""Exact quantiles of many groups, of which any may be too large for one task.

Groups up to a number of rows are left to the built-in aggregate.  Of larger ones
every wanted order statistic is located by histograms: a round counts the values
between the bounds found so far in cells, adds up the counts, and keeps the cell
that holds the wanted rank, with its least and largest value as new bounds.  Cells
are even on a scale of powers of two first and even within one, so at most eight
rounds are needed whatever the spread.  A rank whose cell has one value, or few, is
found; only those few are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.operators.sized import kept, small

CELLS = 1024


def _interpolated(at: Column, low: Column, high: Column) -> Column:
    """The value at place ``at`` between the order statistics around it."""
    below = F.floor(at)
    return F.when(at == below, low).otherwise((below + 1 - at) * low + (at - below) * high)


def _cell(v: Column, low: Column, high: Column) -> Column:
    """0 to CELLS - 1, never falling with v, and not the same for both bounds: even in powers of two where the bounds are more than one apart, and even otherwise."""
    power = lambda x: F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.log2(F.abs(x)) + 1100))
    place = lambda x, a, b: (x - a) / (b - a) * CELLS
    at = F.when(power(high) - power(low) > 1, place(power(v), power(low), power(high))).otherwise(place(v, low, high))
    return F.least(F.greatest(F.floor(at), F.lit(0)), F.lit(CELLS - 1)).cast("int")


def order_statistics(rows: DataFrame, targets: DataFrame, by: list[str], value: str, *, few: int = 4096) -> DataFrame:
    """(by, rank, v): the values of the ranks (from 0) in ``targets`` (by, rank).

    Nulls have to be left out of ``rows`` before, and targets hold ranks that exist.
    """
    bounds = rows.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n"))
    # offset: how many values of the group are below the bounds
    open_ = kept(targets.join(bounds, by).withColumn("offset", F.lit(0).cast("long")))
    found = []
    while True:
        done = open_.filter("low = high")
        found.append(done.select(*by, "rank", F.col("low").alias("v")))
        rest = open_.filter("low < high")
        inside = lambda these: rows.select(*by, value).join(small(these), by).filter(F.col(value).between(F.col("low"), F.col("high")))
        # Ranks of a group between the same bounds share one gathering.
        little = rest.filter(F.col("n") <= few)
        sorted_ = inside(little.select(*by, "low", "high").distinct()).groupBy(*by, "low", "high").agg(F.array_sort(F.collect_list(value)).alias("_all"))
        picked = little.join(sorted_, [*by, "low", "high"]).select(*by, "rank", F.get("_all", (F.col("rank") - F.col("offset")).cast("int")).alias("v"))
        found.append(kept(picked))
        many = kept(rest.filter(F.col("n") > few))
        if many.isEmpty():
            break
        ranges = many.select(*by, "low", "high").distinct()
        cells = inside(ranges).groupBy(*by, "low", "high", _cell(F.col(value), F.col("low"), F.col("high")).alias("cell"))
        counted = cells.agg(F.count("*").alias("c"), F.min(value).alias("a"), F.max(value).alias("b"))
        # At most CELLS rows for each pair of bounds.
        listed = counted.groupBy(*by, "low", "high").agg(F.array_sort(F.collect_list(F.struct("cell", "c", "a", "b"))).alias("cells"))
        joined = many.join(listed, [*by, "low", "high"])
        start = F.struct(F.col("offset").alias("offset"), F.lit(None).cast("struct<c: long, a: double, b: double>").alias("hit"))

        def step(s: Column, x: Column) -> Column:
            hit = F.when(s["hit"].isNull() & (F.col("rank") < s["offset"] + x["c"]), F.struct(x["c"].alias("c"), x["a"].cast("double").alias("a"), x["b"].cast("double").alias("b"))).otherwise(s["hit"])
            return F.struct(F.when(hit.isNull(), s["offset"] + x["c"]).otherwise(s["offset"]).alias("offset"), hit.alias("hit"))

        located = joined.withColumn("_s", F.aggregate("cells", start, step))
        open_ = kept(located.select(*by, "rank", F.col("_s.hit.a").alias("low"), F.col("_s.hit.b").alias("high"), F.col("_s.hit.c").alias("n"), F.col("_s.offset").alias("offset")))
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def grouped_quantiles(rows: DataFrame, by: list[str], value: Column, probabilities: list[float], *, name: str = "q", most: int = 100_000, few: int = 4096) -> DataFrame:
    """(by, name): an array of the exact quantiles, interpolated, of ``value`` in each group, as ``percentile`` gives them.

    Nulls are left out; a group without values has a null.  A group of at most ``most`` rows is aggregated by ``percentile``.
    """
    asked = F.array(*(F.lit(p) for p in probabilities))
    held = rows.select(*by, value.cast("double").alias("_v"))
    large = held.groupBy(*by).agg(F.count("_v").alias("_n")).filter(F.col("_n") > most)
    if large.isEmpty():
        return held.groupBy(*by).agg(F.percentile("_v", asked).alias(name))
    large = kept(large)
    others = held.join(small(large.drop("_n")), by, "left_anti").groupBy(*by).agg(F.percentile("_v", asked).alias(name))
    places = large.select(*by, F.explode(asked).alias("p"), "_n").withColumn("at", F.col("p") * (F.col("_n") - 1))
    ends = places.select(*by, F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).distinct()
    inside = held.join(small(large.drop("_n")), by, "left_semi").filter(F.col("_v").isNotNull())
    stats = order_statistics(inside, ends, by, "_v", few=few)
    low = stats.select(*by, F.col("rank").alias("_low"), F.col("v").alias("_a"))
    high = stats.select(*by, F.col("rank").alias("_high"), F.col("v").alias("_b"))
    valued = places.withColumn("_low", F.floor("at")).withColumn("_high", F.ceil("at")).join(low, [*by, "_low"]).join(high, [*by, "_high"])
    exact = valued.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("p", _interpolated(F.col("at"), F.col("_a"), F.col("_b")).alias("v")))).alias("m"))
    return others.unionByName(exact.select(*by, F.transform(asked, lambda p: F.col("m")[p]).alias(name)))


def grouped_median(rows: DataFrame, by: list[str], value: Column, name: str, **options) -> DataFrame:
    """(by, name): the exact median of ``value`` in each group."""
    return grouped_quantiles(rows, by, value, [0.5], name="_q", **options).select(*by, F.col("_q")[0].alias(name))
