"""Long-term spectra, smoothing, band shares, band edges, steady tones.

Spectra are rows (file, col, bin, mag), or columns (file, col, mags array).  Long-term spectra are aggregated by
(file, bin) with partial aggregation; only then, with one row per bin, are they
gathered into one array per file, whose length is fixed by the frame size.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undula import params as P
from undula.functions import arrays as A
from undula.functions.scalar import power_db
from undula.operators.batches import DOUBLES, FLOATS, by_slices
from undula.operators.frames import block_of, clipped, pool_factor
from undula.operators.quantiles import grouped_median
from undula.operators.sized import kept, small

#: Bins of a column that go together.
SLAB = 64


def _power() -> Column:
    return F.col("mag").cast("double") * F.col("mag").cast("double")


def mean_power(rows: DataFrame) -> DataFrame:
    return rows.groupBy("file", "bin").agg(F.avg(_power()).alias("power"))


def median_power(rows: DataFrame, *by: str) -> DataFrame:
    """Exact medians of the power of each bin, also by block or other keys; of long recordings by histograms."""
    return grouped_median(rows, ["file", *by, "bin"], _power(), "power")


def slabs(columns: DataFrame, *keys: str) -> DataFrame:
    """(keys, slab, x): columns of magnitudes cut in runs of SLAB bins."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("mags") - 1) / SLAB).cast("int")), lambda s: F.struct(s.alias("slab"), F.slice("mags", s * SLAB + 1, SLAB).alias("x")))
    return columns.select(*keys, F.explode(cut).alias("_s")).select(*keys, "_s.slab", "_s.x")


def median_columns(columns: DataFrame, *by: str, most: int = 100_000) -> DataFrame:
    """(file, keys, power array): ``median_power`` of columns as arrays, gathered; of groups beyond ``most`` columns by histograms."""
    keys = ["file", *by]

    def middle(v, k: int) -> np.ndarray:
        places = (k - 1) // 2, k // 2
        p = np.partition(np.asarray(v, np.float64).reshape(k, -1) ** 2, places, axis=0)
        return p[places[0]] * 0.5 + p[places[1]] * 0.5

    # A slab may be large, so only a few are unpacked together.
    medians = by_slices(lambda x, n: [middle(v, k) for v, k in zip(x, n)], "array<double>", DOUBLES, rows=8)

    large = kept(columns.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).drop("_n"))
    long_ = not large.isEmpty()
    few = columns.join(small(large), keys, "left_anti") if long_ else columns
    # A slab of at most ``most`` columns is gathered.
    met = slabs(few, *keys).groupBy(*keys, "slab").agg(F.collect_list("x").alias("x"))
    met = met.select(*keys, "slab", medians(F.flatten("x"), F.size("x")).alias("p"))
    out = met.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("slab", "p"))), lambda s: s["p"])).alias("power"))
    if long_:
        rows = columns.join(small(large), keys, "left_semi").select(*keys, F.posexplode("mags").alias("bin", "mag"))
        out = out.unionByName(gathered(median_power(rows, *by), F.col("power"), *by, name="power"))
    return out


def pooled_columns(columns: DataFrame, max_cols: int) -> DataFrame:
    """``frames.max_pool`` of columns as arrays: (file, col, mags)."""

    largest = by_slices(lambda x, n: [np.asarray(v, np.float32).reshape(k, -1).max(axis=0) for v, k in zip(x, n)], "array<float>", FLOATS)

    n = kept(columns.groupBy("file").agg((F.max("col") + 1).alias("n")).withColumn("p", pool_factor(F.col("n"), max_cols)))
    if n.filter("p > 1").isEmpty():
        return columns.select("file", "col", "mags")
    sized = columns.join(small(n.drop("n")), "file")
    short = sized.filter("p = 1").select("file", "col", "mags")
    runs = slabs(sized.filter("p > 1").withColumn("col", F.floor(F.col("col") / F.col("p")).cast("long")), "file", "col").groupBy("file", "col", "slab").agg(F.collect_list("x").alias("x"))
    top = runs.select("file", "col", "slab", largest(F.flatten("x"), F.size("x")).alias("m"))
    return short.unionByName(top.groupBy("file", "col").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("slab", "m"))), lambda s: s["m"])).alias("mags")))


def gathered(spectrum: DataFrame, value: Column, *by: str, name: str = "db") -> DataFrame:
    """One row for each file (and key): the values in order of bins."""
    pairs = spectrum.groupBy("file", *by).agg(F.array_sort(F.collect_list(F.struct("bin", value.alias("v")))).alias("p"))
    return pairs.select("file", *by, F.transform("p", lambda s: s["v"]).alias(name))


def relative_db(spectrum: DataFrame, *by: str) -> DataFrame:
    """(file, keys, db array): dB below the strongest bin, of a row for each bin or of arrays."""
    found = gathered(spectrum, power_db(F.col("power")), *by) if "bin" in spectrum.columns else spectrum.select("file", *by, F.transform("power", lambda v: power_db(v)).alias("db"))
    return found.select("file", *by, A.let(F.array_max("db"), lambda m: F.transform("db", lambda v: v - m)).alias("db"))


def smoothed(spectrum: DataFrame, value: str, bins: int, *by: str) -> Column:
    """Moving sum over ``bins``, as a window over bins; the window's partition is one spectrum."""
    over = W.partitionBy("file", *by).orderBy("bin").rowsBetween(-(bins // 2), (bins - 1) // 2)
    return F.col(value) if bins < 2 else F.sum(value).over(over) / F.lit(float(bins))


def cutoff(rows: DataFrame, df_hz: float, drop_db: float = 50.0) -> DataFrame:
    """Highest frequency whose mean power is less than ``drop_db`` below the peak."""
    db = mean_power(rows).withColumn("db", power_db(F.col("power"), 1e-12))
    peak = db.groupBy("file").agg(F.max("db").alias("peak"))
    return db.join(peak, "file").filter(F.col("db") > F.col("peak") - drop_db).groupBy("file").agg((F.max("bin") * F.lit(df_hz)).alias("cutoff_hz"))


def band_shares(rows: DataFrame, df_hz: float, nyquist: float, edges: tuple[float, ...] = P.OCTAVES) -> DataFrame:
    """Share of the mean power by band; bands are half-open, the top band holds the Nyquist bin."""
    lows = [e for e in edges if e < nyquist]
    bounds = [int(e / df_hz) for e in lows]
    band = F.lit(0)
    for k, b in enumerate(bounds):
        band = F.when(F.col("bin") >= b, k).otherwise(band)
    power = mean_power(rows).groupBy("file", band.alias("band")).agg(F.sum("power").alias("power"))
    total = power.groupBy("file").agg(F.sum("power").alias("total"))
    low = F.element_at(F.array(*map(F.lit, map(float, lows))), (F.col("band") + 1).cast("int"))
    return power.join(total, "file").select("file", "band", low.alias("lo_hz"), (F.col("power") / (F.col("total") + 1e-12)).alias("share"))


def signal_bandwidth(db: Column, df_hz: float, drop_db: float = 50.0) -> Column:
    """Where the smoothed spectrum last lies above its peak less ``drop_db``."""
    sm = A.moving_mean(db, max(1, int(150 / df_hz)))

    def last(s: Column) -> Column:
        floor = F.array_max(s) - drop_db
        return F.array_max(F.filter(F.transform(s, lambda v, i: F.when(v > floor, i)), lambda i: i.isNotNull())) * F.lit(df_hz)

    return F.bround(A.let(sm, last), 1)


def spectral_edge(db: Column, df_hz: float, nyquist: float, *, min_drop: float = 15.0, min_hz: float = 7000.0, min_steepness: float = 10.0, below_hz: float = 1500.0, above_hz: tuple[float, float] = (300.0, 4000.0)) -> Column:
    """The hard edge of a spectrum as struct(hz, drop_db, floor_db, steepness), or null.

    Candidates compare the median just below with the median above.  The first
    largest drop is moved to the steepest place around it and must be steep.
    """
    first, last = max(int(min_hz / df_hz), 4), int(0.995 * nyquist / df_hz)
    if last <= first:
        return F.lit(None).cast("struct<hz:double,drop_db:double,floor_db:double,steepness:double>")

    def candidate(i: Column) -> Column:
        """Bins from ``b0`` to the candidate and from ``a0`` to ``a1``: what lies just below and what lies above."""
        f = i * F.lit(df_hz)
        whole = lambda x: (x / F.lit(df_hz)).cast("int")
        return F.struct(i.alias("i"), F.greatest(F.lit(4), whole(f - below_hz)).alias("b0"), whole(f + above_hz[0]).alias("a0"), whole(F.least(f + above_hz[1], F.lit(float(nyquist)))).alias("a1"))

    # A rule over bin numbers, so that the expression stays small however many bins there are.
    ask = F.filter(F.transform(F.sequence(F.lit(first), F.lit(last - 1)), candidate), lambda u: (u["i"] - u["b0"] >= 3) & (u["a1"] - u["a0"] >= 3))

    def edge(sm: Column) -> Column:
        def drop(u: Column) -> Column:
            floor = A.median(A.between(sm, u["a0"], u["a1"]))
            return F.struct((A.median(A.between(sm, u["b0"], u["i"])) - floor).alias("drop"), (-u["i"]).alias("i"), floor.alias("floor"))

        return A.let(F.array_max(F.transform(ask, drop)), lambda best: F.when(best["drop"] >= min_drop, refined(sm, best)))

    def refined(sm: Column, best: Column) -> Column:
        n, at, step = F.size(sm), -best["i"], max(1, int(200 / df_hz))
        lo = F.greatest(F.lit(1), at - int(500 / df_hz))
        hi = F.least(n - 2, at + int(4000 / df_hz))
        slopes = F.transform(F.sequence(lo, F.greatest(lo, hi - step - 1)), lambda j: F.get(sm, j) - F.get(sm, j + step))
        place = F.when(hi > lo + 2, lo + A.first_max(slopes)).otherwise(at)
        return A.let(place, lambda i: steep(sm, best, i))

    def steep(sm: Column, best: Column, i: Column) -> Column:
        hz = i * F.lit(df_hz)
        a = F.greatest(F.lit(1), F.floor((hz - 500) / df_hz).cast("int"))
        b = F.least(F.size(sm) - 1, F.floor((hz + 500) / df_hz).cast("int"))
        slope = (F.get(sm, a) - F.get(sm, b)) / F.greatest((b - a) * F.lit(df_hz / 1000), F.lit(1e-6))
        return F.when(slope >= min_steepness, F.struct(F.bround(hz, 1).alias("hz"), F.bround(best["drop"], 1).alias("drop_db"), F.bround(best["floor"], 1).alias("floor_db"), F.bround(slope, 1).alias("steepness")))

    return A.let(A.moving_mean(db, max(1, int(150 / df_hz))), edge)


def with_blocks(rows: DataFrame, per_block: int, most: int) -> DataFrame:
    """Add ``block``, of clip(columns // per_block, 1, most) nearly equal runs of columns."""
    n = rows.groupBy("file").agg((F.max("col") + 1).alias("n"))
    blocks = clipped(F.floor(F.col("n") / per_block), 1, most)
    return rows.join(small(n) if "mags" in rows.columns else n, "file").withColumn("blocks", blocks).withColumn("block", block_of(F.col("col"), F.col("n"), F.col("blocks")))


def band_analysis(rows: DataFrame, codecs: DataFrame, sr: int, nfft: int, **edge) -> DataFrame:
    """(file, codec) with bandwidth, edges by block, pattern and verdict key of each file.

    ``rows`` is read several times: columns as arrays, stored before, are the quick form.
    """
    df_hz, nyquist = sr / nfft, sr / 2
    near = P.NEAR_NYQUIST * nyquist
    medians = median_columns if "mags" in rows.columns else median_power
    # A search for an edge takes long for its few bytes, so the spectra are dealt out by number.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = relative_db(medians(rows)).repartition(tasks, "file")
    whole = whole.select("file", signal_bandwidth(F.col("db"), df_hz).alias("signal_bandwidth_hz"), spectral_edge(F.col("db"), df_hz, nyquist, **edge).alias("full"), A.moving_mean(F.col("db"), max(1, int(150 / df_hz))).alias("sm"))
    blocked = with_blocks(rows, 25, 16)
    sizes = blocked.groupBy("file", "block").agg(F.countDistinct("col").alias("cols")).filter("cols >= 3")
    per_block = relative_db(medians(blocked, "block"), "block").join(sizes, ["file", "block"]).repartition(tasks, "file", "block")
    per_block = per_block.select("file", spectral_edge(F.col("db"), df_hz, nyquist, **edge).alias("e"))
    hit = F.col("e").isNotNull() & (F.col("e.hz") < near)
    stats = per_block.groupBy("file").agg(
        F.count("*").alias("blocks"), F.count_if(hit).alias("blocks_with_edge"),
        *(F.percentile(F.when(hit, F.col(f"e.{c}")), 0.5).alias(a) for c, a in (("hz", "edge_hz"), ("drop_db", "edge_drop_db"), ("floor_db", "floor_db"))),
        F.percentile(F.when(hit, F.col("e.hz")), F.array(F.lit(0.1), F.lit(0.9))).alias("q"),
    )
    below = F.col("full").isNotNull() & (F.col("full.hz") < near)
    start = F.floor(F.col("full.hz") / df_hz).cast("int")

    def first_below(level: Column) -> Column:
        return F.array_min(F.filter(F.transform("sm", lambda v, i: F.when((i >= start) & (v < level), i)), lambda i: i.isNotNull()))

    top = A.median(F.filter("sm", lambda _, i: i >= F.floor(F.size("sm") * 0.98)))
    stop = F.coalesce(first_below(F.get("sm", start) - 40), first_below(top + 6)) * F.lit(df_hz)
    rates = [r for r in P.SOURCE_RATES if sr > 1.5 * r]
    out = whole.join(stats, "file", "left").join(codecs, "file", "left").withColumn("stopband_hz", F.when(below, F.bround(F.coalesce(stop, F.col("full.hz")), 1)))
    if rates:
        nearest = F.array_min(F.array(*(F.struct(F.abs(F.col("stopband_hz") - r / 2).alias("d"), F.lit(r).alias("r")) for r in rates)))
        out = out.withColumn("source_rate_hint", F.when(below & (nearest["d"] < 1800), nearest["r"]))
    else:
        out = out.withColumn("source_rate_hint", F.lit(None).cast("int"))
    up = F.col("source_rate_hint").isNotNull()
    lossless = F.lower(F.coalesce("codec", F.lit(""))).isin(*P.LOSSLESS)
    key = (
        F.when(up & (F.abs(F.col("stopband_hz") - F.col("full.hz")) < 500), "band.upsampled_sharp").when(up, "band.upsampled_slope")
        .when(below & lossless, "band.transcode").when(below, "band.limited")
        .when(F.col("signal_bandwidth_hz").isNull(), "band.none_nobw").otherwise("band.none")
    )
    edge_hz = F.when(below, F.col("full.hz")).otherwise(F.bround("edge_hz", 1))
    hint = F.lit(None).cast("string")
    for bound, name in reversed(P.EDGE_HINTS):
        hint = F.when(edge_hz / 1000 < bound, name).otherwise(hint)
    return out.select(
        "file", "codec", "signal_bandwidth_hz", edge_hz.alias("edge_hz"),
        F.bround(F.coalesce(F.col("blocks_with_edge") / F.nullif("blocks", F.lit(0)), F.lit(0.0)), 2).alias("edge_share"),
        F.bround(F.when(F.col("blocks_with_edge") > 2, F.get("q", F.lit(1)) - F.get("q", F.lit(0))).otherwise(0.0), 1).alias("edge_spread_hz"),
        F.when(up, F.col("full.drop_db")).otherwise(F.bround("edge_drop_db", 1)).alias("edge_drop_db"),
        F.when(up, F.col("full.floor_db")).otherwise(F.bround("floor_db", 1)).alias("floor_db"),
        F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("blocks_with_edge", F.lit(0)).alias("blocks_with_edge"), "stopband_hz", "source_rate_hint",
        F.when(up, "upsampled").when(below, "constant").otherwise("full").alias("pattern"), hint.alias("hint_key"), key.alias("verdict_key"),
        F.when(up | (below & lossless), "warn").otherwise("ok").alias("level"),
    )


def tonal_peaks(rows: DataFrame, sr: int, nfft: int, *, min_hz: float = 5000.0, min_prominence: float = 10.0, min_share: float = 0.8, level: tuple[float, float] = (-95.0, -30.0), blocks: int = 8, limit: int = 6, kernel_hz: float = 400.0, width_hz: float = 60.0, raster_hz: float = 25.0, per_block: int = 20, least_cols: int = 24) -> DataFrame:
    """Steady narrow tones: (file, hz, prominence_db, level_db, share), strongest first, at most ``limit`` for each file.

    Columns as arrays, stored before, are the quick form of ``rows``.
    """
    df_hz = sr / nfft
    top = nfft // 2 + 1
    lo, hi = max(2, int(min_hz / df_hz)), min(top - 2, int(0.98 * (sr / 2) / df_hz))
    kernel, widest = max(3, int(kernel_hz / df_hz)) | 1, max(2, math.ceil(width_hz / df_hz))
    blocked = with_blocks(rows, per_block, blocks).filter((F.col("blocks") >= 3) & (F.col("n") >= least_cols))
    if "mags" in rows.columns:
        med = median_columns(blocked, "blocks", "block").select("file", "blocks", "block", F.posexplode("power").alias("bin", "power")).withColumn("bin", F.col("bin").cast("long"))
    else:
        med = median_power(blocked, "blocks", "block")
    med = med.withColumn("db", power_db(F.col("power")))
    whole = W.partitionBy("file", "block")
    seg = med.withColumn("ref", F.max("db").over(whole)).filter(F.col("bin").between(lo, hi - 1) & F.lit(hi - lo >= 8))
    by_bin = whole.orderBy("bin")
    seg = seg.withColumn("prominence", F.col("db") - smoothed(seg, "db", kernel, "block")).withColumn("before", F.lag("db").over(by_bin)).withColumn("after", F.lead("db").over(by_bin)).withColumn("lvl", F.col("db") - F.col("ref"))
    # Where the level has fallen by 6 dB on either side is found in the neighbours that the widest allowed tone may have.
    near = by_bin.rowsBetween(-(widest + 1), widest + 1)
    seg = seg.withColumn("around", F.collect_list(F.struct("bin", "db")).over(near))
    left = F.array_max(F.transform(F.filter("around", lambda s: (s["bin"] < F.col("bin")) & (s["db"] <= F.col("db") - 6)), lambda s: s["bin"]))
    right = F.array_min(F.transform(F.filter("around", lambda s: (s["bin"] > F.col("bin")) & (s["db"] <= F.col("db") - 6)), lambda s: s["bin"]))
    # past the ends of the segment the walk stops at the last bin
    left = F.coalesce(left, F.when(F.col("bin") - lo <= widest, F.lit(lo)))
    right = F.coalesce(right, F.when(F.lit(hi - 1) - F.col("bin") <= widest, F.lit(hi - 1)))
    peaks = seg.filter(
        (F.col("prominence") > min_prominence) & F.col("before").isNotNull() & F.col("after").isNotNull() & (F.col("db") >= F.col("before")) & (F.col("db") >= F.col("after"))
        & F.col("lvl").between(*level)
    ).withColumn("width", right - left).filter(F.col("width") <= widest)
    keyed = peaks.withColumn("hz", F.col("bin") * F.lit(df_hz)).groupBy("file", F.bround(F.col("hz") / raster_hz).cast("long").alias("key"))
    found = keyed.agg(F.percentile("hz", 0.5).alias("hz"), F.percentile("prominence", 0.5).alias("p"), F.percentile("lvl", 0.5).alias("l"), (F.countDistinct("block") / F.max("blocks")).alias("share"))
    found = found.filter(F.col("share") >= min_share).select("file", F.bround("hz", 1).alias("hz"), F.bround("p", 1).alias("prominence_db"), F.bround("l", 1).alias("level_db"), F.bround("share", 2).alias("share"))
    rank = W.partitionBy("file").orderBy(F.col("prominence_db").desc(), "hz")
    return found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= limit)
