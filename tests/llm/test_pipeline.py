from __future__ import annotations

import random
import re

import corpus_pipeline as P
import pytest

from undula.llm import decontaminate as D
from undula.llm import quality as Q


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(9)
    folder = str(tmp_path_factory.mktemp("sf"))
    vocabulary = [f"word{k}" for k in range(200)]
    item = " ".join(rng.choice(vocabulary) for _ in range(30))
    rows, labels = [], []
    for k in range(240):
        bad = k % 6 == 5
        words = [rng.choice(vocabulary) + ("%%%" if bad else "") for _ in range(rng.randint(20, 80))]
        text = " ".join(words)
        if k % 40 == 1:
            text += " " + item.upper()
        if k % 40 == 2:
            text += " card 4539578763621486 at 10.1.2.3"
        rows.append((k, text, "en", None if k % 7 == 0 else f"s{k % 5}", len(text)))
        labels.append((k, 0 if bad else 1, 0))
    for k in range(240, 260):
        w = rows[(k - 240) * 6][1].split()
        if k % 2:
            w[len(w) // 2] = "other"
        rows.append((k, " ".join(w), "en", "s1", 1))
    rows += [(260, None, None, None, None), (261, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, item


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_stages_in_order(spark, tables):
    folder, item = tables
    assert [n for n, _ in P.STAGES] == ["quality", "near_dups", "decontaminate", "pii", "mix"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES:
        before = docs
        docs = stage(spark, before, folder)
        out = f"{folder}/{name}"
        docs.write.parquet(out)
        docs = spark.read.parquet(out)
        if name != "mix":
            assert docs.columns == list(P.COLUMNS)
        kept[name] = ({r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in docs.collect()})
    before, after = kept["quality"]
    assert all(i not in after for i in range(240) if i % 6 == 5) and sum(i in after for i in range(240) if i % 6 != 5) >= 0.98 * 200
    before, after = kept["near_dups"]
    sets = {i: shingles(r.text) for i, r in before.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert set(after) == {find(i) for i in sets} and len(after) < len(before)
    before, after = kept["decontaminate"]
    assert set(before) - set(after) == {i for i, r in before.items() if D.normalized(item) in D.normalized(r.text)} and set(before) != set(after)
    before, after = kept["pii"]
    assert set(before) == set(after)
    for i, r in after.items():
        assert "4539578763621486" not in (r.text or "") and "10.1.2.3" not in (r.text or "")
        assert re.sub(r"\d", "", r.text or "") == re.sub(r"\d", "", before[i].text or "") or r.text == before[i].text
        assert r.n_chars == (None if r.text is None else len(r.text))
    before, after = kept["mix"]
    assert set(before) == set(after) and all(r.taken == r["size"] * r.repeats for r in after.values())


def test_run_is_the_stages_and_repeats(spark, tables):
    folder, _ = tables
    assert sorted(map(str, P.run(spark, folder).collect())) == sorted(map(str, P.run(spark, folder).collect()))


def test_empty_documents(spark, tables, tmp_path):
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in P.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0


def test_quality_uses_the_operator(spark, tables):
    folder, _ = tables
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    assert {r.doc_id for r in P.quality_stage(spark, docs, folder).collect()} == {r.doc_id for r in Q.select_quality(docs, labels).collect()}
