"""Measurements and reports of the recordings that the tables hold: the vectors of each label, one after the other, as sound of 8 kHz.

SQL has no transforms or filters, so known sounds (``plans.audio``, ``plans.reports``) test the operators, and tests of these
queries check what is known of the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula import params as P
from undula.operators import audio as AU
from undula.operators import comparison as CM
from undula.operators import frames as FR
from undula.operators import reports as RP
from undula.operators import series as SE
from undula.operators import spectrum as SP
from undula.operators.sized import kept
from undula.plans import hosting as H
from undula.sources import store

QUERIES, ORACLE = {}, {}
SR, CHUNK, LAG = 8000, 16000, 37
EDGE = {"min_hz": 1000.0}
#: Reports take the recordings at this rate, as their band analysis has frames of a fixed length.
REPORT_SR = 48000
#: Frames that short recordings fill too.
SHORT = P.Params(nfft=512, overlap=0.5)


def query(f):
    QUERIES[f.__name__] = f
    return f


def _sound(pieces: DataFrame, sr: int = SR) -> DataFrame:
    return SE.rechunked(pieces, CHUNK).select(F.col("file").cast("string").alias("file"), "ch", "chunk", F.lit(sr).alias("sr"), F.col("x").cast("array<float>").alias("x"))


def _pieces(spark: SparkSession, sf: str) -> DataFrame:
    return H.frames(spark, sf).select("file", F.lit(0).alias("ch"), (F.col("col") * 64).alias("first"), "x")


def mono(spark: SparkSession, sf: str, sr: int = SR) -> DataFrame:
    return _sound(_pieces(spark, sf), sr)


def stereo(spark: SparkSession, sf: str) -> DataFrame:
    """A label on the left, the next one there is on the right."""
    a, b = H.neighbours(_pieces(spark, sf))
    left, right = (df.select(F.col("a").alias("file"), F.lit(k).alias("ch"), "first", "x") for k, df in enumerate((a, b)))
    return _sound(left.unionByName(right))


def versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Each recording, and itself at half the level from sample LAG on, with a little of the next recording mixed in."""
    own, other = H.neighbours(_pieces(spark, sf))
    late = own.select(F.col("a").alias("file"), "ch", (F.col("first") - LAG).alias("first"), "x")
    skip = F.greatest(-F.col("first"), F.lit(0))
    begun = late.filter(F.col("first") + F.size("x") > 0).select("file", "ch", F.greatest("first", F.lit(0)).alias("first"), F.slice("x", (skip + 1).cast("int"), F.size("x")).alias("x"))
    b = SE.rechunked(begun, CHUNK)
    c = SE.rechunked(other.select(F.col("a").alias("file"), "ch", "first", "x"), CHUNK).withColumnRenamed("x", "y")
    mixed = b.join(c, ["file", "ch", "chunk"], "left").select("file", "ch", (F.col("chunk") * CHUNK).alias("first"), F.transform("x", lambda v, i: 0.5 * v + 0.05 * F.coalesce(F.get("y", i), F.lit(0.0))).alias("x"))
    return _sound(own.select(F.col("a").alias("file"), "ch", "first", "x")), _sound(mixed)


def info(spark: SparkSession, sf: str, sr: int = REPORT_SR) -> DataFrame:
    """What is known of each recording: name, codec and size."""
    e = H.table(spark, sf, "embeddings").filter("label IS NOT NULL").groupBy(F.col("label").cast("string").alias("file")).agg(F.sum(F.size("embedding")).alias("n"))
    codec = F.when(F.pmod(F.hash("file"), F.lit(2)) == 0, "flac").otherwise("mp3")
    return e.select("file", F.concat("file", F.lit(".wav")).alias("name"), codec.alias("codec"), F.lit(sr).alias("sample_rate"), F.lit(1).alias("channels"), (F.col("n") / sr).alias("duration"), (F.col("n") * 2).alias("size"))


@query
def impulse_scan(spark, sf):
    return AU.impulse_scan(mono(spark, sf), SR, CHUNK, threshold_db=6.0)[1]


@query
def impulse_events(spark, sf):
    return AU.strongest_events(AU.impulse_scan(mono(spark, sf), SR, CHUNK, threshold_db=6.0, lf_margin=0.0)[0])


@query
def lowfreq_scan(spark, sf):
    return AU.lowfreq_scan(mono(spark, sf, 4000), 4000, CHUNK, nfft=1024)


@query
def wow_flutter(spark, sf):
    return AU.wow_flutter(mono(spark, sf), SR, CHUNK)


@query
def tone_sweep(spark, sf):
    response, apart = AU.tone_sweep(stereo(spark, sf), SR, CHUNK)
    return response.join(apart.select("file", "channel_separation_db", "channel_separation_min_db", "verdict_key"), "file")


@query
def tone_steps(spark, sf):
    return AU.tone_steps(stereo(spark, sf), SR, CHUNK)


@query
def loudness_r128(spark, sf):
    """Loudness of the recordings taken at 4 kHz."""
    return AU.loudness(mono(spark, sf, 4000), CHUNK, sr=4000)


@query
def band_edge_audio(spark, sf):
    columns = kept(AU.stft(FR.hop_frames(mono(spark, sf), 512, 256, CHUNK)))
    return SP.band_analysis(columns, info(spark, sf).select("file", "codec"), SR, 512, **EDGE)


@query
def analyse(spark, sf):
    """Level of each channel's loudest bin over a slice of time."""
    rows = RP.panels(RP.spectra(stereo(spark, sf), P.Params(nfft=512, channel="all", start=0.05, duration=60.0), CHUNK))
    return rows.groupBy("file", "ch").agg((F.max("col") + 1).alias("columns"), F.bround(F.max("db"), 3).alias("top_db"))


@query
def band_report(spark, sf):
    return RP.band_report(mono(spark, sf, REPORT_SR), info(spark, sf).select("file", "codec"), SHORT, REPORT_SR, CHUNK)


@query
def quickcheck(spark, sf):
    return RP.quickcheck(mono(spark, sf, REPORT_SR), info(spark, sf), REPORT_SR, CHUNK)


@query
def summary(spark, sf):
    return RP.summary(mono(spark, sf, REPORT_SR), info(spark, sf), SHORT, REPORT_SR, CHUNK)


@query
def scan_folder(spark, sf):
    """A scan of which every other result is stored already, and some of those are stale."""
    about = info(spark, sf)
    files = about.select(F.lit("r").alias("root"), F.col("file").alias("path"), F.lit("quick").alias("kind"), F.lit(1).alias("analysis_version"), F.lit(7).cast("long").alias("mtime_ns"), "size")
    place = F.pmod(F.hash("path"), F.lit(4))
    index = files.filter(place < 3).withColumn("mtime_ns", F.when(place == 0, 6).otherwise(7).cast("long")).withColumn("level", F.lit("ok")).select(*(c.split()[0] for c in store.INDEX.split(", ")))
    return RP.scan(files, index, mono(spark, sf, REPORT_SR), about, REPORT_SR, CHUNK)[2]


@query
def null_report(spark, sf):
    a, b = versions(spark, sf)
    return RP.null_report(a, b, P.Params(), SR, CHUNK, least_seconds=0.1)


@query
def null_residual(spark, sf):
    a, b = versions(spark, sf)
    return RP.residual(a, b, P.Params(), SR, CHUNK, half=256)[1]


@query
def compare(spark, sf):
    """Each recording against the next one there is: offset, band, and how their spectra differ."""
    a, b = (_sound(df.select(F.col("a").alias("file"), "ch", "first", "x"), REPORT_SR) for df in H.neighbours(_pieces(spark, sf)))
    return CM.compare(a, b, info(spark, sf).select("file", "codec"), SHORT, REPORT_SR, CHUNK)[0]


@query
def compare_panels(spark, sf):
    """How many columns each panel of the comparison with the own later version has, and its loudest level."""
    a, b = versions(spark, sf)
    panels = CM.compare(a, b, info(spark, sf).select("file", "codec"), P.Params(nfft=64, overlap=0.5), SR, CHUNK, **EDGE)[1]
    return panels.groupBy("file", "panel").agg(F.count("*").alias("columns"), F.bround(F.max(F.array_max("db")), 2).alias("top_db"))
