"""Mixing sources to target weights by capped water-filling.

Every source has a weight.  Targets share the budget by weight; a source stops
at ``max_epochs`` times its own size and what it cannot take is reshared by
weight among the others.  The resharing loop has a closed form: with sources
ordered by cap / weight, the level L at which ``sum(min(cap, L * weight))``
meets the budget saturates a prefix of that order, so two running sums find it.

A source whose target is r times its size takes floor(r) whole repetitions of
each document and one more repetition of a seeded subset whose words come to
the fractional part.  The subset is a prefix of the documents in the order of a
seeded digest, found by a histogram of digests (4096 buckets for each source)
and an exact pass over the one bucket in which the fraction ends.  So a hot
source is never gathered in one task, and texts are never shuffled.

Defined results: a null text has size 0; a null source is a source of its own
and sorts last; a source of size 0 has target 0; repeated rows with one id fall
together; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undula.llm.common import checkpoint

WORD = r"[^\x20\x09-\x0D]+"
#: Up to so many sources the table of targets is broadcast; beyond it is joined by shuffle.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, *, size: str, weight: str, max_epochs: float, budget: float | None = None) -> DataFrame:
    """Add ``target`` to a table of one row per source; sources are few next to documents."""
    everything = W.partitionBy()
    order = W.orderBy("_ratio", "_cap")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    after = order.rowsBetween(1, W.unboundedFollowing)
    total = F.sum(size).over(everything).cast("double") if budget is None else F.lit(float(budget))
    return (
        sources.withColumn("_cap", F.col(size) * F.lit(float(max_epochs)))
        .withColumn("_weight", F.col(weight).cast("double"))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_total", total)
        .withColumn("_full", F.sum("_cap").over(upto) + F.col("_ratio") * F.coalesce(F.sum("_weight").over(after), F.lit(0.0)) <= F.col("_total"))
        .withColumn("_left", F.col("_total") - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(everything))
        .withColumn("_open", F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_weight"))).over(everything))
        .withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_left") / F.col("_open") * F.col("_weight")))
        .drop("_cap", "_weight", "_ratio", "_total", "_full", "_left", "_open")
    )


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    max_epochs: int = 3,
    seed: str = "mix-1",
) -> DataFrame:
    """``docs`` with size, source_size, target, repeats and taken (words the mix takes of the document).

    Columns of ``docs`` that have one of these names are replaced.
    """
    added = ("size", "source_size", "target", "repeats", "taken")
    docs = docs.drop(*(c for c in docs.columns if c in added and c not in (id_col, text_col, source_col)))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    sized = checkpoint(docs.select(F.col(source_col).alias("__u_source"), digest.alias("_digest"), word_count(F.col(text_col)).alias("_size")))

    per_source = sized.groupBy("__u_source").agg(F.sum("_size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("__u_source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    filled = water_fill(per_source.withColumn("_w", weight), size="source_size", weight="_w", max_epochs=max_epochs).drop("_w")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    filled = checkpoint(
        filled.withColumn("__u_whole", F.least(F.floor(ratio), F.lit(max_epochs)).cast("long")).withColumn("_want", F.greatest(F.lit(0.0), F.col("target") - F.col("__u_whole") * F.col("source_size")))
    )

    # The bucket of digests in which each source's fraction ends, then the last digest of that bucket that still belongs to it.
    bucketed = sized.withColumn("_bucket", F.substring("_digest", 1, 3))
    running = W.partitionBy("__u_source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    ends = (
        bucketed.groupBy("__u_source", "_bucket").agg(F.sum("_size").alias("_words"))
        .withColumn("_base", F.coalesce(F.sum("_words").over(running), F.lit(0)))
        .join(filled.select(F.col("__u_source").alias("_s"), "_want"), F.col("__u_source").eqNullSafe(F.col("_s"))).drop("_s")
        .filter((F.col("_base") <= F.col("_want")) & (F.col("_want") < F.col("_base") + F.col("_words")))
        .select(F.col("__u_source").alias("_s"), F.col("_bucket").alias("_b"), "_base", "_want")
    )
    inside = W.partitionBy("_s").orderBy("_digest").rangeBetween(W.unboundedPreceding, W.currentRow)
    same = W.partitionBy("_s", "_digest")
    last = (
        bucketed.join(ends, F.col("__u_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("_mid", F.col("_base") + F.sum("_size").over(inside) - F.sum("_size").over(same) / 2)
        .groupBy("_s", "_b").agg(F.max(F.when(F.col("_mid") <= F.col("_want"), F.col("_digest"))).alias("__u_last"))
        .select("_s", F.coalesce("__u_last", "_b").alias("__u_last"))
    )
    plan = checkpoint(
        filled.join(last, F.col("__u_source").eqNullSafe(F.col("_s")), "left").select("__u_source", "source_size", "target", "__u_whole", F.coalesce("__u_last", F.lit("")).alias("__u_last"))
    )
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan

    repeats = F.col("__u_whole") + F.when(digest <= F.col("__u_last"), 1).otherwise(0)
    return (
        docs.join(plan, F.col(source_col).eqNullSafe(F.col("__u_source")))
        .withColumn("size", word_count(F.col(text_col)))
        .withColumn("repeats", repeats)
        .withColumn("taken", F.col("size") * F.col("repeats"))
        .drop("__u_source", "__u_whole", "__u_last")
    )


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    from undula.llm.common import read

    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
         CAST(coalesce(len(regexp_extract_all({text}, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM {documents}),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
s1 AS (SELECT *, 3.0::DOUBLE * source_size AS cap, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM s0),
s2 AS (SELECT *, cap / w AS ratio, (sum(source_size) OVER ())::DOUBLE AS total FROM s1),
s3 AS (SELECT *, sum(cap) OVER (ORDER BY ratio, cap ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
         + ratio * coalesce(sum(w) OVER (ORDER BY ratio, cap ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0.0::DOUBLE) <= total AS full_ FROM s2),
s4 AS (SELECT *, total - sum(CASE WHEN full_ THEN cap ELSE 0.0::DOUBLE END) OVER () AS left_,
         sum(CASE WHEN full_ THEN 0.0::DOUBLE ELSE w END) OVER () AS open_ FROM s3),
s5 AS (SELECT source, source_size, CASE WHEN full_ THEN cap ELSE left_ / open_ * w END AS target FROM s4),
s6 AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole FROM s5),
s7 AS (SELECT *, greatest(0.0::DOUBLE, target - whole * source_size) AS want FROM s6),
d AS (SELECT a.doc_id, a.source, a.digest, a.size, s.source_size, s.target, s.whole, s.want,
        (sum(a.size) OVER (PARTITION BY a.source ORDER BY a.digest RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
          - sum(a.size) OVER (PARTITION BY a.source, a.digest) / 2.0::DOUBLE)::DOUBLE AS mid
      FROM sized a JOIN s7 s ON a.source IS NOT DISTINCT FROM s.source)
SELECT {columns} doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN want > 0 AND mid <= want THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d
"""

ORACLE_SQL = ORACLE.format(documents="documents", text="text", columns="")
