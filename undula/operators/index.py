"""The incremental result index: hits, misses, pruning, statistics, eviction; listings and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undula.functions.scalar import base_name, safe_name, slug

KEY = ["root", "path"]
VALID = ["kind", "analysis_version", "mtime_ns", "size"]


def index_hits(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files whose stored result is valid: same place, kind, version, time and size."""
    return files.join(index, KEY + VALID)


def index_misses(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files that have to be computed."""
    return files.join(index, KEY + VALID, "left_anti")


def merge_index(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """The index with ``fresh`` rows in place of older ones of their place and kind; rows with an error are not stored."""
    fresh = fresh.filter("error IS NULL").drop("error") if "error" in fresh.columns else fresh
    return index.join(fresh.select(*KEY, "kind"), [*KEY, "kind"], "left_anti").unionByName(fresh)


def prune(index: DataFrame, files: DataFrame, roots: DataFrame) -> DataFrame:
    """Index rows with ``action``: foreign (root unknown), remove (file gone or changed) or keep."""
    known = F.broadcast(roots.select("root").distinct().withColumn("_known", F.lit(True)))  # a row for each configured folder
    now = files.select(*KEY, F.col("mtime_ns").alias("_m"), F.col("size").alias("_s"))
    same = (F.col("_m") == F.col("mtime_ns")) & (F.col("_s") == F.col("size"))
    action = F.when(F.col("_known").isNull(), "foreign").when(same, "keep").otherwise("remove")
    return index.join(known, "root", "left").join(now, KEY, "left").withColumn("action", action).drop("_known", "_m", "_s")


def index_stats(index: DataFrame, size: Column) -> DataFrame:
    return index.agg(F.count("*").alias("entries"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def lru_evict(cache: DataFrame, limit: int, *, by: tuple[str, ...] = ("atime", "path")) -> DataFrame:
    """Entries to delete: the oldest, until what is left fits ``limit``.

    Running totals go over 4096 ranges of the first key, then within each, so the table is not sorted in one task.
    """
    total, low, high = cache.agg(F.sum("size"), F.min(by[0]), F.max(by[0])).first()  # three numbers
    width = max(1, -(-((high or 0) - (low or 0) + 1) // 4096))
    ranged = cache.withColumn("_range", F.floor((F.col(by[0]) - F.lit(low or 0)) / F.lit(width)))
    per = ranged.groupBy("_range").agg(F.sum("size").alias("_n"))  # at most 4096 rows
    base = per.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    within = W.partitionBy("_range").orderBy(*by).rowsBetween(W.unboundedPreceding, -1)
    older = ranged.join(F.broadcast(base), "_range").withColumn("_before", F.col("_base") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    return older.filter(F.lit(total or 0) - F.col("_before") > limit).drop("_range", "_base", "_before")


def scan_summary(rows: DataFrame) -> DataFrame:
    """rows: level, cached, error"""
    return rows.agg(
        F.count("*").alias("files"), F.count_if(F.col("level") == "warn").alias("warnings"), F.count_if(~F.col("cached") & F.col("error").isNull()).alias("computed"),
        F.count_if(F.col("cached")).alias("cached"), F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


def scan_order(rows: DataFrame, column: str, *, descending: bool = False) -> DataFrame:
    """Sorted for display: missing numbers as -1, missing text as z."""
    text = dict(rows.dtypes)[column] == "string"
    key = F.coalesce(F.col(column), F.lit("z" if text else -1))
    return rows.orderBy(key.desc() if descending else key, "path")


def deduplicated_names(names: DataFrame, name: str, arrival: str) -> DataFrame:
    """Names made safe; a name taken by an earlier arrival gets _1, _2 and so on before its extension."""
    safe = names.withColumn("_safe", safe_name(F.col(name)))
    nth = F.row_number().over(W.partitionBy("_safe").orderBy(arrival)) - 1
    stem, ext = F.regexp_extract("_safe", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("_safe", r"^(.*?)(\.[^.]*)?$", 2)
    return safe.withColumn("_n", nth).withColumn("stored_name", F.when(F.col("_n") == 0, F.col("_safe")).otherwise(F.concat(stem, F.lit("_"), F.col("_n").cast("string"), ext))).drop("_safe", "_n")


def parse_roots(spec: str) -> list[tuple[str, str, str]]:
    """``Label=/path:Label2=/p2`` -> (key, label, path); labels repeated get numbers, keys that clash an x."""
    out: list[tuple[str, str, str]] = []
    seen: dict[str, int] = {}
    for part in filter(None, spec.split(":")):
        label, _, path = part.rpartition("=")
        label = label or path.rstrip("/").rpartition("/")[2] or "root"
        seen[label] = seen.get(label, 0) + 1
        label = label if seen[label] == 1 else f"{label} {seen[label]}"
        key = "".join(c if c.isalnum() else "-" for c in label.lower()).strip("-") or "root"
        while any(key == k for k, _, _ in out):
            key += "x"
        out.append((key, label, path))
    return out


def messages(verdicts: DataFrame, catalogue: DataFrame, lang: str, fallback: str = "de") -> DataFrame:
    """Add ``template`` by ``key``: the language's, else the fallback's, else the key.  The catalogue is a small dimension."""
    pick = lambda code, name: F.broadcast(catalogue.filter(F.col("lang") == code).select("key", F.col("template").alias(name)))  # noqa: E731  a row for each message
    return verdicts.join(pick(lang, "_own"), "key", "left").join(pick(fallback, "_other"), "key", "left").withColumn("template", F.coalesce("_own", "_other", "key")).drop("_own", "_other")


def cache_key(*parts: Column) -> Column:
    """SHA-1 of the parameters that matter, as JSON in a fixed order."""
    return F.sha1(F.to_json(F.struct(*parts)).cast("binary"))


def listing(entries: DataFrame, query: str = "") -> DataFrame:
    """(name, is_dir) of one folder: folders first, names without regard to case; the query filters files only."""
    shown = entries if not query else entries.filter(F.col("is_dir") | F.contains(F.lower("name"), F.lit(query.lower())))
    return shown.orderBy(F.col("is_dir").desc(), F.lower("name"), "name")


def limited(df: DataFrame, n: int, *order: str) -> tuple[DataFrame, bool]:
    """The first n rows, and whether there are more."""
    more = df.orderBy(*order).limit(n + 1)
    return more.limit(n), more.count() > n


def named_paths(paths: DataFrame, path: str) -> DataFrame:
    return paths.withColumn("name", base_name(F.col(path))).withColumn("slug", slug(F.col(path)))


def delete_named(files: DataFrame, names: DataFrame) -> DataFrame:
    """(name, status) of each name asked for, once: ``delete`` if a file of that name exists, else ``unknown``.

    ``files`` and ``names`` have a column ``name``.  Folders before a name asked for are ignored, as only the one folder is searched;
    null and empty names are unknown under the name as asked.
    """
    asked = names.select(F.coalesce(F.nullif(base_name(F.col("name")), F.lit("")), F.col("name")).alias("name")).distinct()
    there = files.select(F.col("name").alias("_name"), F.lit(True).alias("_there")).distinct()
    found = asked.join(there, F.col("name") == F.col("_name"), "left")
    return found.select("name", F.when(F.col("_there"), "delete").otherwise("unknown").alias("status"))


def requested_missing(requested: DataFrame, existing: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``requested``, each once, whose keys ``existing`` lacks; null keys are equal to null keys."""
    return requested.select(*keys).subtract(existing.select(*keys))


def walk_order(path: Column) -> Column:
    """Sorts paths folder by folder: the files of a folder by name, then its subfolders by name, each with all below it."""
    parts = F.split(path, "/")
    return F.transform(parts, lambda name, i: F.concat(F.when(i == F.size(parts) - 1, "0").otherwise("1"), name))


def walked(files: DataFrame, limit: int, *, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(the first ``limit`` visible files in folder order with ``place`` from 1, one row ``truncated``).

    Names that begin with a dot, and all below such folders, are left out; null paths too.  Each task keeps its first
    limit + 1 rows, so no whole sort takes place.
    """
    shown = files.filter(F.col(path).isNotNull() & ~F.exists(F.split(path, "/"), lambda name: name.startswith(".")))
    first = shown.withColumn("_walk", walk_order(F.col(path))).orderBy("_walk").limit(limit + 1)
    placed = first.withColumn("place", F.row_number().over(W.orderBy("_walk"))).drop("_walk")  # limit + 1 rows
    return placed.filter(F.col("place") <= limit), placed.agg((F.count("*") > limit).alias("truncated"))
