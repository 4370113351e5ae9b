from __future__ import annotations

import random

import numpy as np
import pytest

from undula.llm import quality as Q


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    good = [f"word{k}" for k in range(80)]
    rows, labels = [(0, None, "s", 1), (1, "", "s", 2)], []
    for k in range(2, 400):
        bad = k % 4 == 0
        text = " ".join(rng.choice(good) + ("%%%" if bad else "") for _ in range(rng.randint(5, 60)))
        rows.append((k, text, "clash", k))
        if k % 2 == 0 or k % 3 == 0:
            labels.append((k, 0 if bad else 1, 0))
    rows += [(None, "word1 word2", None, None), (6, rows[6][1], "copy", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, _id string, importance int"), spark.createDataFrame(labels + labels[:5] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


def test_bad_documents_go_and_good_ones_stay(tables):
    docs, labels = tables
    kept = Q.select_quality(docs, labels)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(not (k and k > 1 and k % 4 == 0) for k in ids)
    assert sum(k is not None and k > 1 and k % 4 != 0 for k in ids) >= 0.99 * sum(1 for k in texts if k and k > 1 and k % 4)
    assert sorted(map(str, Q.select_quality(docs.repartition(5), labels).collect())) == sorted(map(str, kept.collect()))


def test_scores_and_top_k_against_brute_force(tables):
    docs, labels = tables
    from pyspark.sql import functions as F

    scored = Q.select_quality(docs, labels, k=10**9, score_col="w").collect()
    rows = docs.collect()
    good = {r._id for r in Q.labelled(labels, "quality").collect() if r._label == 1 and r._fold == 0}
    counts = np.ones((2, Q.BUCKETS))
    for r in rows:
        f = np.bincount(Q.features(r.text), minlength=Q.BUCKETS)
        counts[0] += f
        if r.doc_id in good:
            counts[1] += f
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    assert len(scored) == len(rows)
    for r in scored:
        assert abs(r.w - ratio[Q.features(r.text)].sum()) < 1e-9
    noise = {(r.doc_id, r.importance): r.n for r in docs.select("doc_id", "importance", Q._noise("doc_id", 7, 0.5).alias("n")).collect()}
    key = {(r.doc_id, r.importance): r.w + noise[(r.doc_id, r.importance)] for r in scored}
    for k in (1, 7, 100, 390):
        got = Q.select_quality(docs, labels, k=k, temperature=0.5).collect()
        want = sorted(key.values(), reverse=True)[:k]
        have = sorted((key[(r.doc_id, r.importance)] for r in got), reverse=True)
        assert np.allclose(have[:k], want, atol=1e-5) and k <= len(have) <= k + 1  # rows with one id are drawn together
    assert Q.select_quality(docs, labels, k=0).count() == 0
    kept = Q.select_quality(docs, labels, k=100)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    drawn = Q.draw(docs, labels, k=100)
    rows = drawn.rows.filter(drawn.chosen(F.col("key"), F.col("id")))
    assert sorted((r.id or -1) for r in rows.collect()) == sorted((r.doc_id or -1) for r in kept.collect())


@pytest.mark.parametrize("values", [[3, 1, 2], [5] * 40 + [7], list(range(-9000, 9000, 3)), [2**61, -(2**61), 0, 1]])
def test_kth_largest(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in {1, 2, len(values) // 2, len(values)}:
        value, above = Q.kth_largest(df, "v", k, bins=8)
        assert value == sorted(values, reverse=True)[k - 1] and above == sum(v > value for v in values)


def test_cut():
    s, g = np.array([1.0, 2, 3, 4]), np.array([False, False, True, True])
    assert Q.best_cut(s, g, 4.0) == 2.5
    assert Q.best_cut(np.array([1.0, 1, 1]), np.array([True, False, True]), 4.0) == -np.inf
    assert Q.best_cut(np.zeros(0), np.zeros(0, bool), 4.0) == -np.inf


def test_without_labels_or_rows(tables):
    docs, labels = tables
    assert Q.select_quality(docs, labels.limit(0)).count() == docs.count()
    assert Q.select_quality(docs.limit(0), labels).count() == 0
    assert Q.select_quality(docs, labels.filter("quality = 1")).count() == docs.count()


def test_held_out_labels(spark, sf):
    """Learned from a fifth less of the labels, judged on that fifth."""
    sf = f"{sf}/../sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r.doc_id for r in Q.select_quality(docs, labels.filter("doc_id % 5 <> 0")).collect()}
    ids = {r.doc_id for r in docs.collect()}
    held = [r for r in labels.filter("doc_id % 5 = 0").collect() if r.doc_id in ids]
    good = [r.doc_id in kept for r in held if r.quality == 1]
    bad = [r.doc_id in kept for r in held if r.quality == 0]
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.1
