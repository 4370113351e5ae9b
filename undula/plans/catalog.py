"""Queries over the result index, listings, names and messages, with their SQL.

``documents`` stand for media files (path from the id, size from n_chars, an mtime
from the id) and ``labels`` for the stored index.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from undula.functions import scalar as S
from undula.functions import templates
from undula.operators import index as IX
from undula.operators import nested
from undula.plans.hosting import table

QUERIES, ORACLE = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _files(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("source").alias("root"), F.concat(F.lit("/media/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".flac")).alias("path"), F.lit("quick:60:en").alias("kind"),
        F.lit(1).alias("analysis_version"), (F.col("doc_id") * 1000).alias("mtime_ns"), F.col("n_chars").alias("size"), "doc_id",
    )


def _index(spark, sf):
    """Stored results; every third is of another size than the file, and one folder is not configured."""
    stored = _files(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    return stored.select("root", "path", "kind", "analysis_version", "mtime_ns", F.when(F.col("doc_id") % 3 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(F.col("quality") == 1, "ok").otherwise("warn").alias("level"))


FILES = """files AS (SELECT source AS root, '/media/' || lang || '/' || doc_id || '.flac' AS path, 'quick:60:en' AS kind, 1 AS analysis_version, doc_id * 1000 AS mtime_ns, n_chars AS size, doc_id FROM documents),
stored AS (SELECT root, path, kind, analysis_version, mtime_ns, size + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS size, CASE WHEN quality = 1 THEN 'ok' ELSE 'warn' END AS level FROM files JOIN labels USING (doc_id))"""


@query(f"WITH {FILES} SELECT doc_id, root, path, i.level FROM files f JOIN stored i USING (root, path, kind, analysis_version, mtime_ns, size)")
def incremental_hits(spark, sf):
    return IX.index_hits(_files(spark, sf), _index(spark, sf)).select("doc_id", "root", "path", "level")


@query(f"WITH {FILES} SELECT doc_id, root, path FROM files f ANTI JOIN stored i USING (root, path, kind, analysis_version, mtime_ns, size)")
def incremental_misses(spark, sf):
    return IX.index_misses(_files(spark, sf), _index(spark, sf)).select("doc_id", "root", "path")


@query(f"""WITH {FILES} SELECT i.root, i.path, CASE WHEN i.root = 'src3' THEN 'foreign' WHEN f.size = i.size AND f.mtime_ns = i.mtime_ns THEN 'keep' ELSE 'remove' END AS action
FROM stored i LEFT JOIN (SELECT * FROM files WHERE doc_id % 10 <> 7) f USING (root, path)""")
def index_prune(spark, sf):
    """Every tenth file is gone, and the folder src3 is not configured."""
    files = _files(spark, sf)
    roots = files.select("root").distinct().filter("root <> 'src3'")
    return IX.prune(_index(spark, sf), files.filter("doc_id % 10 <> 7"), roots).select("root", "path", "action")


@query(f"WITH {FILES} SELECT count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes FROM stored")
def index_stats(spark, sf):
    return IX.index_stats(_index(spark, sf), F.col("size"))


@query("""
SELECT doc_id, n_chars AS size FROM (SELECT *, sum(n_chars) OVER () AS total, coalesce(sum(n_chars) OVER (ORDER BY doc_id % 100, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM documents)
WHERE total - before_ > 1000000""")
def lru_evict(spark, sf):
    cache = table(spark, sf, "documents").select((F.col("doc_id") % 100).alias("atime"), F.col("doc_id").alias("path"), F.col("n_chars").alias("size"))
    return IX.lru_evict(cache, 1_000_000).select(F.col("path").alias("doc_id"), "size")


def _scan(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = docs.join(labels, "doc_id", "left")
    error = F.when(F.col("doc_id") % 97 == 5, F.concat(F.lit("cannot read /media/x/"), F.col("doc_id").cast("string"), F.lit(".flac")))
    return rows.select("doc_id", F.col("doc_id").cast("string").alias("path"), F.when(F.col("quality") == 1, "ok").when(F.col("quality") == 0, "warn").alias("level"), F.col("quality").isNotNull().alias("cached"), error.alias("error"), "n_chars")


@query("""
SELECT count(*) AS files, count(*) FILTER (quality = 0) AS warnings, count(*) FILTER (quality IS NULL AND d.doc_id % 97 <> 5) AS computed, count(*) FILTER (quality IS NOT NULL) AS cached, count(*) FILTER (d.doc_id % 97 = 5) AS errors
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def scan_summary(spark, sf):
    return IX.scan_summary(_scan(spark, sf))


@query("SELECT d.doc_id, coalesce(CASE quality WHEN 1 THEN 'ok' WHEN 0 THEN 'warn' END, 'z') AS level FROM documents d LEFT JOIN labels l USING (doc_id) ORDER BY 2, CAST(doc_id AS VARCHAR) LIMIT 200")
def scan_sorted(spark, sf):
    """The first 200 rows of the listing by verdict; a listing is a top-k report."""
    return IX.scan_order(_scan(spark, sf), "level").limit(200).select("doc_id", F.coalesce("level", F.lit("z")).alias("level"))


@query("""
SELECT d.doc_id, CASE WHEN d.doc_id % 97 = 5 THEN 'error' ELSE coalesce(CASE quality WHEN 1 THEN 'ok' WHEN 0 THEN 'warn' END, '') END AS level, format('{:.1f}', n_chars / 8.0::DOUBLE) AS duration,
  CASE WHEN d.doc_id % 97 = 5 THEN 'cannot read ' || d.doc_id || '.flac' ELSE '' END AS message FROM documents d LEFT JOIN labels l USING (doc_id)""")
def scan_csv_rows(spark, sf):
    """Rows as the export writes them."""
    return _scan(spark, sf).select(
        "doc_id", F.when(F.col("error").isNotNull(), "error").otherwise(F.coalesce("level", F.lit(""))).alias("level"),
        F.format_string("%.1f", F.bround(F.col("n_chars") / 8.0, 1)).alias("duration"), F.coalesce(S.clean_message(F.col("error")), F.lit("")).alias("message"),
    )


CATALOGUE = [("en", "q.good", "clean"), ("de", "q.good", "sauber"), ("de", "q.poor", "auffällig"), ("fr", "q.good", "propre")]


@query("""
WITH c AS (SELECT * FROM (VALUES ('en', 'q.good', 'clean'), ('de', 'q.good', 'sauber'), ('de', 'q.poor', 'auffällig'), ('fr', 'q.good', 'propre')) t(lang, key, template)),
v AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'q.toxic' WHEN quality = 1 THEN 'q.good' ELSE 'q.poor' END AS key FROM labels)
SELECT doc_id, key, coalesce((SELECT template FROM c WHERE c.key = v.key AND lang = 'en'), (SELECT template FROM c WHERE c.key = v.key AND lang = 'de'), key) AS template FROM v""")
def message_render(spark, sf):
    """Message text in English, else German, else the key."""
    verdicts = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "q.toxic").when(F.col("quality") == 1, "q.good").otherwise("q.poor").alias("key"))
    return IX.messages(verdicts, spark.createDataFrame(CATALOGUE, "lang string, key string, template string"), "en").select("doc_id", "key", "template")


@query(r"SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug, split_part(replace(url, '\', '/'), '/', -1) AS name FROM pages")
def slug_names(spark, sf):
    return IX.named_paths(table(spark, sf, "pages"), "url").select("page_id", "slug", "name")


@query("""
SELECT doc_id, CASE WHEN n = 0 THEN name ELSE regexp_extract(name, '^(.*?)(\\.[^.]*)?$', 1) || '_' || n || regexp_extract(name, '^(.*?)(\\.[^.]*)?$', 2) END AS stored_name FROM (
  SELECT doc_id, source || '.wav' AS name, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents)""".replace("\\\\", "\\"))
def dedupe_names(spark, sf):
    names = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("/in/"), F.col("source"), F.lit(".wav")).alias("name"))
    return IX.deduplicated_names(names, "name", "doc_id").select("doc_id", "stored_name")


@query("SELECT ext, count(*) AS n FROM (SELECT lower(regexp_extract(url, '\\.([^./]+)$', 1)) AS ext FROM pages) GROUP BY ext".replace("\\\\", "\\"))
def ext_filter(spark, sf):
    return table(spark, sf, "pages").groupBy(S.extension(F.col("url")).alias("ext")).agg(F.count("*").alias("n"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, TRY_CAST(json_extract_string(props, '$.bit_rate') AS BIGINT) AS bit_rate FROM events")
def json_probe(spark, sf):
    """Numbers of a JSON document; null where there is none or it is no number."""
    get = lambda name: F.expr(f"try_cast(get_json_object(props, '$.{name}') AS bigint)")
    return table(spark, sf, "events").select("event_id", get("k").alias("k"), get("bit_rate").alias("bit_rate"))


@query("SELECT doc_id, n_chars // 60 || ':' || lpad(CAST(n_chars % 60 AS VARCHAR), 2, '0') AS shown FROM documents")
def time_labels(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.minutes(F.col("n_chars").cast("double")).alias("shown"))


@query("SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY 1, 2")
def upload_totals(spark, sf):
    return table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("bytes"))


@query("SELECT doc_id, sha1('{\"lang\":\"' || lang || '\",\"n\":' || n_chars || '}') AS key FROM documents")
def cache_keys(spark, sf):
    return table(spark, sf, "documents").select("doc_id", IX.cache_key(F.col("lang").alias("lang"), F.col("n_chars").alias("n")).alias("key"))


TEMPLATES = [
    ("en", "doc.long", "{source}: {kilo:.1f} thousand characters, {change:+.2f} dB, rate {rate:g}"), ("de", "doc.long", "{source}: {kilo:.1f} Tausend Zeichen, {change:+.2f} dB, Rate {rate:g}"),
    ("de", "doc.short", "{n:.0f} Zeichen in {{{source}}}"), ("en", "doc.odd", "no {field} here"),
]


@query("""
WITH rows AS (SELECT doc_id, source, n_chars / 1000.0::DOUBLE AS kilo, n_chars::DOUBLE AS n, (n_chars % 997 - 450) / 8.0::DOUBLE AS change, n_chars / 4.0::DOUBLE AS rate,
  CASE WHEN n_chars % 5 = 0 THEN 'doc.odd' WHEN n_chars >= 1000 THEN 'doc.long' WHEN n_chars % 7 = 0 THEN 'doc.none' ELSE 'doc.short' END AS key FROM documents),
texts AS (SELECT *, printf('%.1f', round_even(kilo, 1)) AS k1, CASE WHEN change < 0 THEN '-' ELSE '+' END || printf('%.2f', abs(round_even(change, 2))) AS c2, printf('%g', rate) AS g FROM rows)
SELECT doc_id, lang, key, CASE key WHEN 'doc.none' THEN key WHEN 'doc.odd' THEN CASE lang WHEN 'en' THEN 'no {field} here' ELSE key END WHEN 'doc.short' THEN printf('%.0f', n) || ' Zeichen in {' || source || '}'
  ELSE CASE lang WHEN 'en' THEN source || ': ' || k1 || ' thousand characters, ' || c2 || ' dB, rate ' || g ELSE source || ': ' || replace(k1, '.', ',') || ' Tausend Zeichen, ' || replace(c2, '.', ',') || ' dB, Rate ' || replace(g, '.', ',') END END AS text
FROM texts, (VALUES ('en'), ('de')) l(lang)""")
def message_texts(spark, sf):
    """A message for every document in two languages, from templates that a table holds."""
    n = F.col("n_chars")
    key = F.when(n % 5 == 0, "doc.odd").when(n >= 1000, "doc.long").when(n % 7 == 0, "doc.none").otherwise("doc.short")
    rows = table(spark, sf, "documents").select("doc_id", "source", (n / 1000.0).alias("kilo"), n.cast("double").alias("n"), ((n % 997 - 450) / 8.0).alias("change"), (n / 4.0).alias("rate"), key.alias("key"))
    both = rows.withColumn("lang", F.explode(F.array(F.lit("en"), F.lit("de"))))
    return templates.rendered(both, spark.createDataFrame(TEMPLATES, "lang string, key string, template string")).select("doc_id", "lang", "key", "text")


_NESTED = """
WITH e AS (SELECT event_id, event_type, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
p AS (SELECT *, '/media/' || event_type || '/' || k || '.wav' AS own, '/media/' || event_type || '/' || user_id || '.wav' AS other FROM e),
known AS (SELECT DISTINCT own AS path, 'lib/' || event_type || '/' || k AS shown FROM p WHERE k % 3 <> 0)
SELECT event_id, '{"deep":{"list":[{"path":"' || coalesce(b.shown, other) || '"},"path",{"path":7}],"note":"{\\"path\\":\\"' || own || '\\"}","path":"' || coalesce(a.shown, own) || '"},"k":' || k || ',"path":"' || coalesce(a.shown, own) || '"}' AS stripped
FROM p LEFT JOIN known a ON a.path = own LEFT JOIN known b ON b.path = other"""


@query(_NESTED.replace("\\\\", "\\"))
def strip_nested_paths(spark, sf):
    """Server paths three deep in a document of each event, replaced where they are known."""
    e = table(spark, sf, "events").select("event_id", "event_type", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    place = lambda name: F.concat(F.lit("/media/"), "event_type", F.lit("/"), F.col(name).cast("string"), F.lit(".wav"))
    own = e.withColumn("own", place("k")).withColumn("other", place("user_id"))
    doc = F.concat(
        F.lit('{ "path" : "'), "own", F.lit('", "deep": {"path":"'), "own", F.lit('", "list":[{"path": "'), "other", F.lit('"}, "path", {"path": 7}], "note":"{\\"path\\":\\"'), "own", F.lit('\\"}"}, "k": '), F.col("k").cast("string"), F.lit("}")
    )
    known = own.filter("k % 3 <> 0").select(F.col("own").alias("path"), F.concat(F.lit("lib/"), "event_type", F.lit("/"), F.col("k").cast("string")).alias("shown")).distinct()
    return nested.strip_paths(own.withColumn("doc", doc), "doc", known).select("event_id", "stripped")


@query("""WITH asked AS (SELECT DISTINCT CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE '' END || doc_id || '.flac' AS name FROM labels)
SELECT name, CASE WHEN name IN (SELECT doc_id || '.flac' FROM documents WHERE doc_id % 7 <> 0) THEN 'delete' ELSE 'unknown' END AS status FROM asked""")
def delete_by_name(spark, sf):
    """Labelled files asked for by name, some with folders before it, some that never were there."""
    doc = F.concat(F.col("doc_id").cast("string"), F.lit(".flac"))
    files = table(spark, sf, "documents").filter("doc_id % 7 <> 0").select(doc.alias("name"))
    names = table(spark, sf, "labels").select(F.concat(F.when(F.col("doc_id") % 2 == 0, "../a/").otherwise(""), F.when(F.col("doc_id") % 5 == 0, "x").otherwise(""), doc).alias("name"))
    return IX.delete_named(files, names)



@query("SELECT user_id, event_type FROM events WHERE value > 10 EXCEPT SELECT user_id, event_type FROM events WHERE value <= 10")
def requested_missing(spark, sf):
    """Users' event types with a level above 10 that have none at or below it."""
    e = table(spark, sf, "events")
    return IX.requested_missing(e.filter("value > 10"), e.filter("value <= 10"), "user_id", "event_type")


@query("""
WITH files AS (SELECT doc_id, source || '/' || CASE WHEN doc_id % 11 = 0 THEN '.cache/' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang || '/' END || doc_id || '.flac' AS path FROM documents),
visible AS (SELECT *, string_split(path, '/') AS parts FROM files WHERE path NOT LIKE '%/.%'),
placed AS (SELECT *, row_number() OVER (ORDER BY list_transform(parts, lambda name, i: CASE WHEN i = len(parts) THEN '0' ELSE '1' END || name)) AS place FROM visible)
SELECT doc_id, path, place, (SELECT count(*) FROM visible) > 2000 AS truncated FROM placed WHERE place <= 2000""")
def folder_walk(spark, sf):
    """The first 2000 files, as a scan takes them, folder by folder, and whether there are more."""
    some = lambda cond, text: F.when(cond, text).otherwise("")
    path = F.concat("source", F.lit("/"), some(F.col("doc_id") % 11 == 0, ".cache/"), some(F.col("doc_id") % 3 != 0, F.concat("lang", F.lit("/"))), F.col("doc_id").cast("string"), F.lit(".flac"))
    rows, more = IX.walked(table(spark, sf, "documents").select("doc_id", path.alias("path")), 2000)
    return rows.join(F.broadcast(more))  # one row
