from __future__ import annotations

import zlib

import numpy as np
import pytest

from undula.llm import toxicity as T


@pytest.fixture(scope="module")
def scored(spark, sf):
    big = f"{sf}/../sf0.1"
    return T.op10_toxicity(spark, big).toPandas(), spark.read.parquet(f"{big}/labels.parquet").toPandas(), spark.read.parquet(f"{big}/documents.parquet").toPandas()


def test_held_out_accuracy(scored):
    got, labels, docs = scored
    assert len(got) == len(docs) and got["score"].between(0, 1).all() and ((got["score"] >= 0.5).astype(int) == got["predicted"]).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    held = got[got["held_out"]].merge(labels, on="doc_id")
    hit = (held["predicted"] == 1) & (held["toxic"] == 1)
    rank = held["score"].rank()
    pos = (held["toxic"] == 1).sum()
    auc = (rank[held["toxic"] == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(held) - pos))
    assert hit.sum() / (held["predicted"] == 1).sum() >= 0.95 and hit.sum() / pos >= 0.8 and auc >= 0.95


def test_only_words_count(spark):
    docs = spark.createDataFrame([(k, t, s, l) for k, (t, s, l) in enumerate([("you idiot", "a", "en"), ("you idiot", "b", "fr"), (None, "a", "en"), ("", "b", "de"), ("fine words", "a", "en"), ("word " * 100_000 + "idiot idiot idiot", "c", "en")])] + [(0, "you idiot", "a", "en")], "doc_id long, text string, source string, score string")
    got = T.score_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(got) == 7
    by = {r.doc_id: r.score for r in got}
    assert by[0] == by[1] and by[2] == by[3] == by[4] < 0.5 < by[5]


def test_held_out_labels_teach_nothing(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    docs = spark.createDataFrame([(i, "zork zork zork" if i % 2 else "plain text") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    assert len({r.score for r in T.score_toxicity(docs, labels).collect()}) == 1
    more = [i for i in range(1000, 1400) if zlib.crc32(str(i).encode()) % 5]
    both = docs.union(spark.createDataFrame([(i, "zork zork zork" if i % 2 else "plain text") for i in more], docs.schema))
    model = T.score_toxicity(both, spark.createDataFrame([(i, i % 2) for i in more] + [(more[0], 1), (None, 1), (more[1], None)], labels.schema))
    assert all(r.predicted == r.doc_id % 2 for r in model.collect())


def test_label_model_finds_accuracies_and_repeats():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    voter = lambda a, b: np.where(y, rng.random(4000) < a, rng.random(4000) < b)
    good, weak, other, third = voter(0.8, 0.02), voter(0.4, 0.2), voter(0.7, 0.03), voter(0.6, 0.05)
    votes = np.stack([good, good, weak, other, third, ~(good | weak | other | third)], axis=1).astype(float)
    post, found = T.label_model(votes)
    assert (((post >= 0.5) == y).mean()) > 0.92
    fires = found["fires1"] - found["fires0"]
    assert fires[0] > fires[3] > fires[4] > fires[2] > 0 and found["fires0"][0] < 0.06
    assert found["weight"][0] < found["weight"][2] < found["weight"][4]


def test_calibration():
    rng = np.random.default_rng(1)
    z = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(3 * z - 2)))).astype(int)
    slope, shift = T.calibration(z, y)
    assert abs(slope - 3) < 0.4 and abs(shift + 2) < 0.4
    assert T.calibration(np.zeros(5), np.array([0, 0, 0, 0, 1]))[0] >= 0.1


def test_ties_and_repeated_ids(spark):
    """Equal texts get equal scores, and an id that is repeated very often teaches once."""
    ids = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, "zork zork zork" if i % 3 == 0 else "plain text") for i in ids]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in ids], "doc_id long, toxic int")
    schema = "doc_id long, text string"
    one = {r.doc_id: r.score for r in T.score_toxicity(spark.createDataFrame(rows, schema), labels).collect()}
    many = T.score_toxicity(spark.createDataFrame(rows + [rows[0]] * 2000, schema), labels).collect()
    assert len(many) == len(rows) + 2000 and len({round(r.score, 12) for r in many}) == len(set(one.values())) == 2
    assert {r.doc_id: r.predicted for r in many} == {i: int(s >= 0.5) for i, s in one.items()} == {i: int(i % 3 == 0) for i in ids}


def test_units_and_empty_table(spark):
    assert T.units("abcdef") == ["abcdef", "abcd~", "abcde~", "abcdef~"]
    assert T.unit_counts("Ab ab, ABCD1", None)["ab"] == 2
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert T.score_toxicity(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0
