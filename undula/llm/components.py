"""Connected components of an edge list, by alternating large and small stars.

Each round costs two partial aggregations and two joins over the edges; the
number of rounds is logarithmic.  Edges are never gathered by vertex: the
smallest neighbours of hubs (of which there are few by count) are broadcast, so
a hub's edges stay where they are; only the edges of other vertices are shuffled.
What a round leaves is kept in as many parts as it has edges for, so that the many
small rounds at the end cost little.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm.common import checkpoint, hot_limit


#: Edges in a part of what a round leaves.
PART = 100_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select("b", "a"))


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def _with_low(edges: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """``edges`` with the value ``m`` that ``low`` (a, m, n) has for their ``a``; n is the number of edges of a."""
    hubs = low.filter(F.col("n") > hot_limit(total)).select("a", F.col("m").alias("hub"))
    marked = edges.join(F.broadcast(hubs), "a", "left")
    others = marked.filter("hub IS NULL").select("a", "b").join(low.select("a", "m"), "a")
    return marked.filter("hub IS NOT NULL").select("a", "b", F.col("hub").alias("m")).union(others.select("a", "b", "m"))


def components(edges: DataFrame) -> DataFrame:
    """(a long, b long) -> (node, component): the smallest node that each node reaches.  Nodes without an edge are left out."""
    e = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    mark = _mark(e)
    while mark[0]:
        both = _both_ways(e)
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = _with_low(both, low, 2 * mark[0]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _with_low(large, low, mark[0]).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        made = small.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        e = checkpoint(made.coalesce(1 + mark[0] // PART))  # a round makes no more edges than there were
        was, mark = mark, _mark(e)
        if mark == was:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
