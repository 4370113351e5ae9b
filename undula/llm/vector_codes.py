"""Product codes of vectors: one codebook for each of several equal parts, by Lloyd's algorithm with Hamerly's bounds.

Components become whole numbers, so that distances, sums and codebooks are exact
and do not depend on the order of rows.  Vectors are packed in blocks; a block
holds the numbers, and for every part its entry, an upper bound of the distance
to it and one lower bound of the distance to the second nearest.  A round moves
the bounds by what the entries have moved, and scans all entries of a part only
if its upper bound is not strictly below its lower bound and below half the way
to the entry's nearest other entry; so a tie is always scanned, and the lower
index wins.  Bounds are stored rounded outwards.

A round reads the blocks of the round before and writes its own, in one of two
folders in turn, below the shared checkpoint folder; each block also carries the
sums and counts of its entries, which are added up by Spark.  Only codebooks pass
through the driver.

Defined results: a vector that is null, empty, or holds null or non-finite
components takes no part; vectors of unlike length, or of a length that the parts
do not divide, are padded by zeros; ids that repeat take part as often, and of
these the vector that sorts first starts a codebook; rows without id take part but start no codebook
unless there are too few others; fewer vectors than entries give as many entries as there are vectors; equal
entries are allowed, the lower index is taken; no vectors give an empty result.
Components beyond 2 ** 27 after scaling raise an error, as sums would not fit.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm.common import ensure_checkpoint_dir, join_split, partitions, read

MOST = 1 << 27
STATE = "block string, n int, ids binary, null_ids binary, labels binary, data binary, width int, entry binary, upper binary, lower binary, scanned long, sums array<long>"


def whole_components(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; null if the vector takes no part."""
    x = F.transform(vector, lambda v: F.floor(v.cast("double") * scale))
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf")))
    small = F.forall(vector, lambda v: F.abs(v.cast("double") * scale) <= MOST)
    checked = F.when(small, x).otherwise(F.raise_error(F.lit("a component is too large for whole numbers")).cast("array<long>"))
    return F.when((F.size(vector) > 0) & F.coalesce(finite, F.lit(False)), checked)


# -- a block -------------------------------------------------------------------


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries, as whole numbers."""
    return ((x[:, None, :] - book[None, :, :]) ** 2).sum(2)


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.asarray(x, np.float64).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.asarray(x, np.float64).astype(np.float32), np.float32(-np.inf))


def _moved(old: np.ndarray | None, book: np.ndarray) -> np.ndarray:
    """How far each entry of (part, entry, place) has moved, no less."""
    return np.zeros(book.shape[:2]) if old is None else _up(np.sqrt(((book - old) ** 2).sum(2))).astype(np.float64)


def assigned(x: np.ndarray, book: np.ndarray, moved: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest entry of each row of one part, its bounds, and how many rows were scanned.

    ``upper`` and ``lower`` are those of the last round, before the entries moved by ``moved``; infinite and zero at first.
    """
    k = len(book)
    between = _distances(book, book).astype(np.float64)
    np.fill_diagonal(between, np.inf)
    half = _down(np.sqrt(between.min(1)) / 2).astype(np.float64) if k > 1 else np.full(1, np.inf)
    most = np.sort(moved)[::-1]
    # The second nearest can have come closer by the largest move of another entry.
    others = np.where(np.arange(k) == moved.argmax(), most[1] if k > 1 else 0.0, most[0])
    upper, lower = _up(upper + moved[entry]).astype(np.float64), _down(lower - others[entry]).astype(np.float64)
    bound = np.maximum(lower, half[entry])
    open_ = np.flatnonzero(~(upper < bound))
    upper[open_] = _up(np.sqrt(((x[open_] - book[entry[open_]]) ** 2).sum(1)))
    open_ = open_[~(upper[open_] < bound[open_])]
    for at in range(0, len(open_), 4096):
        rows = open_[at : at + 4096]
        d = _distances(x[rows], book)
        best = d.argmin(1)
        entry[rows] = best
        upper[rows] = _up(np.sqrt(d[np.arange(len(rows)), best]))
        d = d.astype(np.float64)
        d[np.arange(len(rows)), best] = np.inf
        lower[rows] = np.where(np.isinf(d.min(1)), np.inf, _down(np.sqrt(d.min(1))))
    return entry, upper, lower, len(open_)


def _start_blocks(parts: int, width: int, rows: int):
    """Packs (id, label, v); all bounds fail."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, len(batch), rows):
                cut = batch.iloc[at : at + rows]
                n = len(cut)
                data = np.zeros((n, width), np.int64)
                for k, v in enumerate(cut["v"]):
                    data[k, : len(v)] = v
                narrow = np.int16 if np.abs(data).max(initial=0) < 1 << 15 else np.int32
                labels = "\n".join(cut["label"]).encode()
                yield pd.DataFrame([{
                    "block": f"{part}-{made}", "n": n, "ids": cut["id"].fillna(0).to_numpy(np.int64).tobytes(), "null_ids": np.packbits(cut["id"].isna()).tobytes(), "labels": labels,
                    "data": data.astype(narrow).tobytes(), "width": width, "entry": bytes(n * parts), "upper": np.full(n * parts, np.inf, np.float32).tobytes(),
                    "lower": np.zeros(n * parts, np.float32).tobytes(), "scanned": 0, "sums": [],
                }])
                made += 1

    return run


def _numbers(row) -> np.ndarray:
    return np.frombuffer(row.data, np.int16 if len(row.data) == 2 * row.n * row.width else np.int32).reshape(row.n, row.width).astype(np.int64)


def _round(book: np.ndarray, old: np.ndarray | None):
    """Assigns every part and adds up what the entries were given."""
    parts, k, size = book.shape
    moved = _moved(old, book)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                x = _numbers(row).reshape(row.n, parts, size)
                entry = np.frombuffer(row.entry, np.uint8).reshape(row.n, parts).astype(np.int64)
                upper, lower = (np.frombuffer(b, np.float32).reshape(row.n, parts).astype(np.float64) for b in (row.upper, row.lower))
                sums, counts, scanned = np.zeros((parts, k, size), np.int64), np.zeros((parts, k), np.int64), 0
                for p in range(parts):
                    entry[:, p], upper[:, p], lower[:, p], n = assigned(x[:, p], book[p], moved[p], entry[:, p].copy(), upper[:, p], lower[:, p])
                    np.add.at(sums[p], entry[:, p], x[:, p])
                    counts[p] = np.bincount(entry[:, p], minlength=k)
                    scanned += n
                out.append(row._replace(entry=entry.astype(np.uint8).tobytes(), upper=_up(upper).tobytes(), lower=_down(lower).tobytes(), scanned=scanned, sums=np.concatenate([sums.ravel(), counts.ravel()])))
            yield pd.DataFrame(out, columns=batch.columns)

    return run


def _coded(book: np.ndarray):
    """(id, label, code, error) of the rows of blocks."""
    parts, _, size = book.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                x = _numbers(row).reshape(row.n, parts, size)
                entry = np.frombuffer(row.entry, np.uint8).reshape(row.n, parts)
                error = ((x - book[np.arange(parts), entry]) ** 2).sum((1, 2))
                hexed = row.entry.hex()
                gone = np.unpackbits(np.frombuffer(row.null_ids, np.uint8), count=row.n).astype(bool)
                ids = pd.array(np.frombuffer(row.ids, np.int64), dtype="Int64")
                ids[gone] = pd.NA
                code = [hexed[i : i + 2 * parts] for i in range(0, len(hexed), 2 * parts)]
                yield pd.DataFrame({"id": ids, "label": row.labels.decode().split("\n"), "code": code, "error": error})

    return run


# -- rounds ----------------------------------------------------------------------


def quantize(vectors: DataFrame, *, parts: int = 8, entries: int = 16, rounds: int = 6, rows: int = 4096) -> tuple[DataFrame, np.ndarray, list[int]]:
    """Codes of (id long, label string, v array<long>), the final codebooks (part, entry, place) and the number of parts scanned in each round.

    The codes are (id, label, code, error).  Labels must not hold line breaks.  Codebooks start as the parts of the vectors with the smallest ids.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's index has to fit a byte")
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/codes-{uuid.uuid4().hex}"
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    longest = vectors.agg(F.max(F.size("v")).alias("n")).first()["n"] or 0
    size = -(-longest // parts)
    book = np.zeros((parts, len(first), size), np.int64)
    for e, r in enumerate(first):
        book[:, e] = np.pad(np.array(r["v"], np.int64), (0, parts * size - len(r["v"]))).reshape(parts, size)
    if not len(first):
        return spark.createDataFrame([], "id long, label string, code string, error long"), book, []

    def written(df: DataFrame, k: int) -> DataFrame:
        # Only this round and the one before are kept.
        df.write.mode("overwrite").parquet(f"{folder}/{k % 2}")
        return spark.read.schema(STATE).parquet(f"{folder}/{k % 2}")

    blocks = vectors.mapInPandas(_start_blocks(parts, parts * size, rows), STATE)
    old, scans = None, []
    for k in range(rounds + 1):
        blocks = written(blocks.mapInPandas(_round(book, old), STATE), k)
        scans.append(int(blocks.agg(F.sum("scanned")).first()[0]))
        if k == rounds:
            break
        sums = np.zeros(book.size + book.shape[0] * book.shape[1], np.int64)
        for r in blocks.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s")).toLocalIterator():
            sums[r["at"]] = r["s"]
        total, count = sums[: book.size].reshape(book.shape), sums[book.size :].reshape(book.shape[:2])[..., None]
        old, book = book, np.where(count > 0, total // np.maximum(count, 1), book)
    codes = blocks.select("n", "ids", "null_ids", "labels", "data", "width", "entry").mapInPandas(_coded(book), "id long, label string, code string, error long")
    return codes, book, scans


def digest(book: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def vector_codes(table: DataFrame, *, id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:  # noqa: A002
    """(vec_id, code, error, label_error, codebooks_sha256) of the vectors of ``table``."""
    # A label is carried as text; "n" stands for null.
    text = F.coalesce(F.concat(F.lit("v"), F.base64(F.col(label).cast("string").cast("binary"))), F.lit("n"))
    vectors = table.select(F.col(id).cast("long").alias("id"), F.regexp_replace(text, "[\r\n]", "").alias("label"), whole_components(F.col(vector), scale).alias("v")).filter(F.col("v").isNotNull())
    codes, book, _ = quantize(vectors, parts=parts, entries=entries, rounds=rounds)
    by_label = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    return join_split(codes, by_label, ["label"]).select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(book)).alias("codebooks_sha256"))


# -- query -----------------------------------------------------------------------


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors: 8 parts, 16 entries, 6 rounds."""
    return vector_codes(read(spark, sf_dir, "embeddings"))


def oracle(rounds: int = 6) -> str:
    """The same in SQL: plain Lloyd, all entries scanned in each round."""
    steps = []
    for k in range(rounds + 1):
        near = f"""near{k} AS MATERIALIZED (SELECT vec_id, x.part, x.c, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
  SELECT x.vec_id, x.part, x.c, b.e, list_sum(list_transform(list_zip(x.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM cut x JOIN book{k} b USING (part)) x GROUP BY ALL)"""
        move = f"""book{k + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN (
  SELECT part, e, list(floor(s::DOUBLE / n)::BIGINT ORDER BY i) AS c FROM (
    SELECT part, e, i, sum(v)::BIGINT AS s, count(*) AS n FROM (SELECT part, e, unnest(c) AS v, unnest(range(len(c))) AS i FROM near{k}) GROUP BY ALL) GROUP BY ALL) m USING (part, e))"""
        steps += [near] + ([move] if k < rounds else [])
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (SELECT vec_id, p AS part, v[p * len(v) // 8 + 1 : (p + 1) * len(v) // 8] AS c FROM kept, range(8) r(p)),
book0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, c FROM cut QUALIFY e < 16),
{", ".join(steps)},
codes AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id),
sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM codes JOIN kept USING (vec_id), sha
"""


ORACLE = oracle()
