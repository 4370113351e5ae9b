"""Whole reports on made-up recordings with known answers, for tests; the queries themselves report on the recordings of ``plans.recordings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from undula import params as P
from undula.operators import reports as RP
from undula.plans.audio import TAU, hiss
from undula.sources import store
from undula.sources.pcm import synthetic

SR, CHUNK = 8000, 8192
EDGE = {"min_hz": 1000.0}
INFO = "file string, name string, codec string, sample_rate int, channels int, duration double, size long"


def _band(t, top: int, seed: int):
    """Four sweeps a second from 0 up to a frequency, over a little noise."""
    u = t - F.floor(t * 4) / 4
    return F.sin(u * u * F.lit(TAU * 2 * top)) * 0.2 + hiss(t, seed, 0.0001)


def collection(spark):
    """(chunks, info) of two recordings, one cut off at 2.5 kHz."""
    sound = {"cut": lambda t: [_band(t, 2500, 2), _band(t, 2500, 3)], "full": lambda t: [_band(t, 4000, 4)]}
    chunks = synthetic(spark, dict.fromkeys(sound, 6.0), sound, sr=SR, chunk=CHUNK)
    return chunks, spark.createDataFrame([("cut", "cut.flac", "flac", SR, 2, 6.0, 1000), ("full", "full.wav", "pcm_s16le", SR, 1, 6.0, 2000)], INFO)


def versions(spark):
    """Two versions of one recording: the second starts 0.1 s later, is half as loud and has clicks taken out."""

    def clicks(t):
        return sum((F.when(F.abs(t - at) < 0.0002, 0.5).otherwise(0.0) for at in (1.0, 2.0, 3.5)), F.lit(0.0))

    music = lambda t: F.sin((t * 200 + t * t * 150) * F.lit(TAU)) * 0.1  # noqa: E731  a slow sweep
    make = lambda f: synthetic(spark, {"take": 5.0}, {"take": f}, sr=SR, chunk=CHUNK)
    return make(lambda t: [music(t) + clicks(t)]), make(lambda t: [music(t + 0.1) * 0.5])


def analyse(spark, sf):
    """Level of each channel's loudest bin over a slice of time."""
    chunks, _ = collection(spark)
    rows = RP.panels(RP.spectra(chunks, P.Params(nfft=512, overlap=0.5, channel="all", start=1.5, duration=2.0), CHUNK))
    return rows.groupBy("file", "ch").agg((F.max("col") + 1).alias("columns"), F.bround(F.max("db"), 3).alias("top_db"))


def band_report(spark, sf):
    chunks, info = collection(spark)
    return RP.band_report(chunks, info.select("file", "codec"), P.Params(start=1.0), SR, CHUNK, **EDGE)


def quickcheck(spark, sf):
    chunks, info = collection(spark)
    return RP.quickcheck(chunks, info, SR, CHUNK, seconds=4.0, **EDGE)


def summary(spark, sf):
    chunks, info = collection(spark)
    return RP.summary(chunks, info, P.Params(nfft=1024, overlap=0.5), SR, CHUNK, **EDGE)


def scan_folder(spark, sf):
    """A scan of which one of two results is stored already."""
    chunks, info = collection(spark)
    files = info.select(F.lit("r").alias("root"), F.col("file").alias("path"), F.lit("quick").alias("kind"), F.lit(1).alias("analysis_version"), F.lit(7).cast("long").alias("mtime_ns"), "size")
    index = spark.createDataFrame([("r", "full", "quick", 1, 7, 2000, "ok"), ("r", "cut", "quick", 1, 6, 1000, "ok")], store.INDEX)
    return RP.scan(files, index, chunks, info, SR, CHUNK, seconds=4.0, **EDGE)[2]


def null_report(spark, sf):
    a, b = versions(spark)
    return RP.null_report(a, b, P.Params(), SR, CHUNK)


def null_residual(spark, sf):
    a, b = versions(spark)
    return RP.residual(a, b, P.Params(), SR, CHUNK)[1]
