"""Streaming queries over the events table, with the SQL of their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from undula.plans import timeline
from undula.plans.hosting import sql, table
from undula.sources.store import shared_folder
from undula.streaming import framed as FD
from undula.streaming import twins as ST
from undula.streaming import upserts as UP

QUERIES, ORACLE = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


@query(timeline.ORACLE["tumble_windows"])
def stream_tumble(spark, sf):
    out = ST.tumbling(ST.events_stream(spark, sf), "1 hour", "event_type")
    return ST.collected(out, ["event_type", "start_us"]).withColumn("total", F.round("total", 6))


@query(timeline.ORACLE["hop_windows"])
def stream_hop(spark, sf):
    out = ST.tumbling(ST.events_stream(spark, sf), "6 hours", "event_type", hop="2 hours")
    return ST.collected(out, ["event_type", "start_us"]).withColumn("total", F.round("total", 6))


@query(timeline.ORACLE["session_runs"])
def stream_session(spark, sf):
    """Sessions are final once the watermark is past them; with all input there at once, in the complete table."""
    out = ST.sessions(ST.events_stream(spark, sf), "6 hours", "user_id")
    return ST.collected(out, ["user_id", "start_us"], "complete").withColumn("total", F.round("total", 6))


@query(sql("""
SELECT file AS event_type, CAST(frame // p AS BIGINT) AS col, round(max(x), 6) AS mag, max(p) AS factor FROM (
  SELECT s.*, (SELECT CAST(min(1 << k) AS BIGINT) FROM (SELECT unnest(generate_series(0, 20)) AS k) WHERE n // (1 << k) < 64) AS p
  FROM series s JOIN (SELECT file, count(*) AS n FROM series GROUP BY file) USING (file)) GROUP BY 1, 2"""))
def stream_pool(spark, sf):
    out = ST.running_pool(ST.events_stream(spark, sf), "event_type", 32)
    found = ST.collected(out, ["event_type", "col"])
    # columns that a later halving did away with
    last = found.groupBy("event_type").agg(F.max("factor").alias("factor"))
    return found.join(last, ["event_type", "factor"]).select("event_type", "col", F.round("mag", 6).alias("mag"), "factor")


def _marked(spark, sf):
    """The event files as a stream, and the mark that ends them: a day without an event, long after the last one, closes what is open."""
    marks = shared_folder(spark, "marks")
    end = table(spark, sf, "events").agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"))
    end.select(F.lit(None).cast("long").alias("event_id"), "ts", F.lit(None).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("props")).write.parquet(marks)
    read = lambda folder, glob: spark.readStream.schema(ST.EVENTS).option("pathGlobFilter", glob).parquet(folder)
    both = read(sf, "events*.parquet").unionByName(read(marks, "part-*"))
    return both.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")


@query("""
WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS k FROM events WHERE value IS NOT NULL),
n AS (SELECT event_type, count(*) AS n FROM s GROUP BY 1),
f AS (SELECT event_type, unnest(generate_series(0, (n - 64) // 48)) AS frame FROM n WHERE n >= 64)
SELECT event_type, CAST(frame AS BIGINT) AS frame, round(sqrt(avg(value * value)), 6) AS rms FROM f JOIN s USING (event_type) WHERE k BETWEEN frame * 48 AND frame * 48 + 63 GROUP BY 1, 2
UNION ALL SELECT event_type, 0, 0.0 FROM n WHERE n < 64""")
def stream_frames(spark, sf):
    """Levels of overlapping frames of each event type, cut while the events come in."""
    before = spark.conf.get(FD.STORE)
    spark.conf.set(FD.STORE, FD.ROCKS)
    try:
        frames = FD.series_frames(_marked(spark, sf), "event_type", 64, 48, span="6 hours", gap="2 days")
        rms = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v) / F.size("x"))
        return ST.collected(frames.select("event_type", "frame", F.round(rms, 6).alias("rms")), ["event_type", "frame"], "append")
    finally:
        spark.conf.set(FD.STORE, before)


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
_LOG = """
log AS (SELECT source, doc_id, CASE WHEN toxic = 1 THEN 'warn' WHEN quality IS NOT NULL THEN 'ok' END AS level, doc_id % 3 = 0 AND quality IS NOT NULL AS cached, quality IS NULL AS failed
  FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id))"""


def _log(spark, sf):
    """The log of a scan as a stream: documents are files, labels their results; where there is none, reading failed."""
    # A pattern, as the table may be one file or a folder of files; a stream takes no plain path of a file.
    docs = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", 4).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/documents.parque[t]")
    found = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    none = F.col("quality").isNull()
    return docs.select("source", "doc_id").join(found, "doc_id", "left").select(
        "source", "doc_id", F.when(F.col("toxic") == 1, "warn").when(~none, "ok").alias("level"), ((F.col("doc_id") % 3 == 0) & ~none).alias("cached"), F.when(none, "not read").alias("error")
    )


@query(f"""WITH {_LOG.strip()} SELECT source, count(*) AS total, count(*) AS done, count(*) FILTER (level = 'warn') AS warnings, count(*) FILTER (NOT cached AND NOT failed) AS computed,
count(*) FILTER (cached) AS cached, count(*) FILTER (failed) AS errors, 'done' AS state FROM log GROUP BY 1""")
def scan_progress(spark, sf):
    """Counters of each source after the last batch of the log, stopped and started again on the way."""
    totals = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("total"))
    folder = shared_folder(spark, "progress")
    for _ in range(2):  # the second start finds nothing new
        UP.upsert(UP.progress(_log(spark, sf), totals, "source"), folder, ["source"], mode="update").awaitTermination()
    return UP.current(spark, folder, ["source"], "source string, total long, done long, warnings long, computed long, cached long, errors long, state string")


@query(f"WITH {_LOG.strip()} SELECT doc_id, source, level, cached FROM log WHERE NOT failed")
def index_upserts(spark, sf):
    """The index after the log: a row for each file that could be read."""
    folder = shared_folder(spark, "index")
    UP.upsert(_log(spark, sf).filter("error IS NULL").drop("error"), folder, ["doc_id"]).awaitTermination()
    return UP.current(spark, folder, ["doc_id"], "doc_id long, source string, level string, cached boolean")


@query("""SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS done, count(*) OVER (PARTITION BY source) AS total FROM documents""")
def scan_events(spark, sf):
    """What a scan reports with each file: how many of its source are done, of how many."""
    docs = table(spark, sf, "documents").select("doc_id", "source")
    totals = docs.groupBy(F.col("source").alias("_source")).agg(F.count("*").alias("total"))
    return UP.done_counts(docs, "source", "doc_id", span=F.floor(F.col("doc_id") / 65_536)).join(totals, F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "source", "done", "total")
