"""Quality filtering by importance resampling over hashed n-grams.

Two bags of hashed word n-grams are generative models: one of target text (the
documents labelled good) and one of all text.  A document's importance is the
log ratio of its probabilities under the two.  Documents are sampled without
replacement by Gumbel top-k: seeded standard Gumbel noise (times a temperature, 1
by default) is added to each log ratio and the k largest sums are kept, which
draws documents in proportion to their importance.  k is given, or the number of
documents whose importance reaches the cut that tells labelled good documents from
labelled bad ones best.

Counts cover the whole corpus: each task adds up its own and sends at most one
number for each bucket and model.  The k-th largest sum is found exactly by
refining histograms; ids and sums are all that is written for it.  Texts stay in
the tasks that read them.

Bounds: the target model and the cut come from at most ``sample`` labelled rows
(the first by a digest of the id); that table is broadcast, 16 bytes a row.

Defined results: a null text is empty and an empty text has importance 0; rows
with one id are drawn together; null ids get the noise of an empty id; without
usable labels all documents are kept; an empty table gives an empty result;
other columns are kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm.common import checkpoint

BUCKETS = 1 << 14
SAMPLE = 20_000
#: Keys are compared as whole numbers of this unit.
UNIT = 2.0**-20

_TOKEN = re.compile(r"\w+|[^\w\s]+")


class _Codes(dict):
    """Token -> CRC-32, remembered up to a number of tokens."""

    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:
            self.clear()
        code = self[token] = zlib.crc32(token.encode())
        return code


_CODES = _Codes()


def features(text: str | None) -> np.ndarray:
    """Buckets of the words and symbol runs of a text and of their pairs."""
    codes = np.array([_CODES[t] for t in _TOKEN.findall((text or "").lower())], np.int64)
    pairs = codes[:-1] * 1_000_003 ^ codes[1:] * 7919
    return np.concatenate([codes, pairs]) & (BUCKETS - 1)


def labelled(labels: DataFrame, column: str, *, id_col: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` rows (id, label, fold 0 or 1), one for each id.  Fold 0 makes the target model, fold 1 the cut."""
    rows = labels.filter(F.col(id_col).isNotNull() & F.col(column).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(column).cast("int").alias("_label"))
    return rows.orderBy(F.xxhash64("_id"), "_id").limit(sample).withColumn("_fold", F.pmod(F.xxhash64(F.lit(1), "_id"), F.lit(2)).cast("int"))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for text, target in zip(batch["text"], batch["target"]):
            found = np.bincount(features(text), minlength=BUCKETS)
            counts[0] += found
            if target:
                counts[1] += found
    model, bucket = np.nonzero(counts)
    yield pd.DataFrame({"model": model.astype(np.int32), "bucket": bucket.astype(np.int32), "n": counts[model, bucket]})


def log_ratios(docs: DataFrame, sample: DataFrame, *, id_col: str, text_col: str) -> np.ndarray:
    """For each bucket the log of its probability in target text over that in all text; add-one smoothing."""
    good = F.broadcast(sample.filter("_label = 1 AND _fold = 0").select("_id"))
    marked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(good, F.col("id") == F.col("_id"), "left")
    counted = marked.select("text", F.col("_id").isNotNull().alias("target")).mapInPandas(_count, "model int, bucket int, n long")
    counts = np.ones((2, BUCKETS))
    for row in counted.groupBy("model", "bucket").agg(F.sum("n").alias("n")).collect():  # at most 2 * BUCKETS rows
        counts[row.model, row.bucket] += row.n
    if counts[1].sum() == BUCKETS:
        return np.zeros(BUCKETS)
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def importance(ratios: np.ndarray):
    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series([float(ratios[features(t)].sum()) for t in text], dtype=float)

    return score.asNondeterministic()  # so that a filter on the score does not score once more


def best_cut(score: np.ndarray, label: np.ndarray, clean_weight: float) -> float:
    """The cut with the least weighted shares of good documents below it and bad ones at or above it."""
    if not len(score) or label.all() or not label.any():
        return -np.inf
    order = np.argsort(score, kind="stable")
    s, good = score[order], label[order]
    lost = np.concatenate([[0], np.cumsum(good)]) / good.sum() * clean_weight
    kept = np.concatenate([[0], np.cumsum(~good)])
    cost = lost + (kept[-1] - kept) / kept[-1]
    cost[1:-1][s[1:] == s[:-1]] = np.inf
    k = int(cost.argmin())
    return -np.inf if k == 0 else float(s[-1] + 1) if k == len(s) else float((s[k - 1] + s[k]) / 2)


def kth_largest(df: DataFrame, column: str, k: int, *, bins: int = 4096) -> tuple[int, int]:
    """(the k-th largest value of a long column, how many rows are larger), by refining a histogram of at most ``bins`` bins."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    above = 0
    while low < high:
        width = -(-(high - low + 1) // bins)
        bin_ = F.floor((F.col(column) - low) / width).cast("int") if high - low < 2**52 else F.expr(f"cast(({column} - {low}) div {width} as int)")
        counts = sorted(df.filter(F.col(column).between(low, high)).groupBy(bin_.alias("b")).count().collect(), reverse=True)
        for b, n in counts:
            if above + n >= k:
                low, high = low + b * width, min(high, low + (b + 1) * width - 1)
                break
            above += n
    return low, above


def _noise(id_col: str, seed: int, temperature: float):
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 12).cast("double") + 0.5) / F.lit(2.0**52)
    return F.lit(temperature) * -F.log(-F.log(u))


class Draw:
    """A draw of documents: ``rows`` (id, score, key) of all, and the bounds that a key has to reach."""

    def __init__(self, rows: DataFrame, score, key, least: int | None, last: int | None, none: bool = False):
        self.rows, self.score, self.key, self.least, self.last, self.none = rows, score, key, least, last, none

    def chosen(self, key, id_):
        """Whether a document of this key and id is drawn; ties go to small ids."""
        if self.none:
            return F.lit(False)
        return F.lit(True) if self.least is None else (key > self.least) | ((key == self.least) & (F.coalesce(id_, F.lit(0)) <= self.last))


def draw(
    docs: DataFrame,
    labels: DataFrame,
    *,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    clean_weight: float = 4.0,
    temperature: float = 1.0,
    k: int | None = None,
    seed: int = 7,
    sample: int = SAMPLE,
) -> Draw:
    """Score all documents once and draw k of them.

    ``clean_weight``: how many times worse it is to lose a good document than to keep a bad one.
    """
    known = checkpoint(labelled(labels, label_col, id_col=id_col, sample=sample))
    score = importance(log_ratios(docs, known, id_col=id_col, text_col=text_col))

    def key(id_, value):
        return F.floor((value + _noise(id_, seed, temperature)) / F.lit(UNIT)).cast("long")

    rows = docs.select(F.col(id_col).cast("long").alias("id"), score(F.col(text_col)).alias("score"))
    rows = checkpoint(rows.withColumn("key", key("id", F.col("score"))))
    n = rows.count()
    if k is None:
        judged = rows.join(F.broadcast(known.filter("_fold = 1")), F.col("id") == F.col("_id")).groupBy("id").agg(F.max("score").alias("score"), F.max("_label").alias("label")).toPandas()  # at most ``sample`` ids
        cut = best_cut(judged["score"].to_numpy(), judged["label"].to_numpy() == 1, clean_weight)
        k = rows.filter(F.col("score") >= F.lit(cut)).count() if np.isfinite(cut) else n
    if k >= n or k <= 0:
        return Draw(rows, score, key, None, None, none=k <= 0)
    least, above = kth_largest(rows, "key", k)
    ties = rows.filter(F.col("key") == least).select((-F.coalesce("id", F.lit(0))).alias("id"))
    return Draw(rows, score, key, least, -kth_largest(ties, "id", k - above)[0])


def select_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", score_col: str | None = None, **options) -> DataFrame:
    """The documents drawn, with their columns and, if asked for, their log importance in ``score_col``.

    Texts are not moved to the rows of the draw: they are scored once more where they are read.
    """
    drawn = draw(docs, labels, id_col=id_col, text_col=text_col, **options)
    if drawn.none:
        docs = docs.filter(F.lit(False))
    if score_col is None and drawn.least is None:
        return docs
    scored = docs.withColumn("__u_score", drawn.score(F.col(text_col)))
    kept = scored.filter(drawn.chosen(drawn.key(id_col, F.col("__u_score")), F.col(id_col)))
    return (kept if score_col is None else kept.withColumn(score_col, F.col("__u_score"))).drop("__u_score")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    from undula.llm.common import read

    drawn = draw(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return drawn.rows.filter(drawn.chosen(F.col("key"), F.col("id"))).select(F.col("id").alias("doc_id"), F.col("score").alias("importance"))
