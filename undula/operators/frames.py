"""Frames, pools and blocks.

Long recordings are tables of chunks (file, ch, chunk, x array<float>), all
chunks of a file of one length but the last.  Frames are cut within chunks, with
the head of the next chunk brought along by a join, so one long recording is
spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(df: DataFrame, file: str, order: str, value: Column, *, span: Column | None = None) -> DataFrame:
    """(file, col, x): rows of a file numbered by ``order`` from 0.

    ``span`` rises with ``order``: rows are numbered within spans, and spans by their counts, so that a file is not sorted in one task.
    """
    span = F.lit(0) if span is None else span
    rows = df.select(F.col(file).alias("file"), F.col(order).alias("_order"), span.alias("_span"), value.alias("x"))
    counts = rows.groupBy("file", "_span").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("file").orderBy("_span").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = counts.select(F.col("file").alias("_file"), F.col("_span").alias("_of"), before.alias("_base"))
    within = F.row_number().over(W.partitionBy("file", "_span").orderBy("_order")) - 1
    joined = rows.withColumn("_k", within).join(base, F.col("file").eqNullSafe(F.col("_file")) & F.col("_span").eqNullSafe(F.col("_of")))
    return joined.select("file", (F.col("_base") + F.col("_k")).cast("long").alias("col"), "x")


def hop_frames(chunks: DataFrame, nfft: int, hop: int, chunk: int) -> DataFrame:
    """(file, ch, frame, x array of nfft): frame f starts at sample f * hop; what is left at the end is dropped.

    A recording shorter than a frame has one frame of zeros.
    """
    if chunk < nfft:
        raise ValueError("a chunk must hold a frame")
    head = chunks.select("file", "ch", (F.col("chunk") - 1).alias("chunk"), F.slice("x", 1, nfft - 1).alias("head"))
    both = chunks.join(head, ["file", "ch", "chunk"], "left")
    at = F.col("chunk") * chunk
    first = F.ceil(at / hop).cast("long")
    has = F.size("x") + F.coalesce(F.size("head"), F.lit(0))
    last = F.floor((at + F.least(F.lit(chunk - 1), has - nfft)) / hop).cast("long")
    joined = F.concat("x", F.coalesce("head", F.array().cast("array<float>")))
    # Chunks hold a frame, so only the first and only chunk of a short recording has less at frame 0.
    short = (F.col("chunk") == 0) & (has < nfft)
    zero = F.lit(0).cast("long")
    both = both.filter((has >= nfft) | short)
    cut = both.select(
        "file", "ch", "chunk", F.when(short, F.array_repeat(F.lit(0.0).cast("float"), nfft)).otherwise(joined).alias("x"), F.when(short, zero).otherwise(first).alias("first"), F.when(short, zero).otherwise(last).alias("last")
    ).filter("last >= first")
    # Frames are cut before they become rows: a row with its whole chunk would be held, and spilled, for each frame.
    frames = F.transform(F.sequence("first", "last"), lambda f: F.struct(f.alias("frame"), F.slice("x", (f * hop - F.col("chunk") * chunk + 1).cast("int"), nfft).alias("x")))
    return cut.select("file", "ch", F.inline(frames))


def project_channel(left: Column, right: Column | None, channel: str) -> Column:
    """mix, left, right, mid or side of a sample; mono stays as it is."""
    if right is None:
        return left
    mono = (left + right) / 2
    return {"mix": mono, "mid": mono, "left": left, "right": right, "side": (left - right) / 2}[channel]


def bins_of(spectra: DataFrame, mags: str = "mags") -> DataFrame:
    """(file, col, bin, mag)"""
    return spectra.select("file", "col", F.posexplode(mags).alias("bin", "mag")).withColumn("bin", F.col("bin").cast("long"))


def pool_factor(n: Column, max_cols: int) -> Column:
    """The least power of two p with n div p < 2 * max_cols."""
    need = F.floor(n / F.lit(2 * max_cols)) + 1
    # n div p < m  <=>  p > n / m  <=>  p >= floor(n / m) + 1
    return F.when(need <= 1, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(need.cast("double"))))).cast("long")


def max_pool(rows: DataFrame, max_cols: int) -> DataFrame:
    """(file, col, bin, mag) -> the same with runs of columns pooled by their largest value."""
    n = rows.groupBy("file").agg((F.max("col") + 1).alias("n"))
    pooled = rows.join(n, "file").withColumn("p", pool_factor(F.col("n"), max_cols))
    return pooled.groupBy("file", F.floor(F.col("col") / F.col("p")).cast("long").alias("col"), "bin").agg(F.max("mag").alias("mag"))


def block_of(col: Column, n: Column, blocks: Column) -> Column:
    """Which of ``blocks`` nearly equal runs of n columns holds ``col``: the first n mod blocks runs are one longer.  No sort is needed."""
    size, rest = F.floor(n / blocks), F.pmod(n, blocks)
    long_ = rest * (size + 1)
    return F.when(col < long_, F.floor(col / (size + 1))).otherwise(rest + F.floor((col - long_) / F.greatest(size, F.lit(1)))).cast("long")


def clipped(x: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))
