from __future__ import annotations

import random

import numpy as np
import pytest

from undula.llm import decontaminate as D


def edits(p: str, t: str) -> int:
    """Least edits of p against any part of t."""
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_hashes_are_of_q_characters():
    codes = np.frombuffer("abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz".encode("utf-32-le"), np.uint32)
    for q in (1, 3, 8, 12, 13):
        h = D._hashes(codes, q)
        assert len(h) == len(codes) - q + 1 and h[0] == h[26] and len(np.unique(h)) == 26
    assert len(D._hashes(codes[:5], 12)) == 0


@pytest.mark.parametrize("seed", range(4))
def test_banded_distance(seed):
    rng = random.Random(seed)
    for _ in range(30):
        p = words(rng, 8)
        t = list(p)
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(len(t))
            rng.choice((lambda: t.pop(k), lambda: t.insert(k, "x"), lambda: t.__setitem__(k, "y")))()
        region = words(rng, 3) + "".join(t) + words(rng, 3)
        want = edits(p, region)
        got = D.banded_distance(p, region, 5)
        assert (got[0] if got else None) == (want if want <= 5 else None)
        if got:
            assert edits(p, region[got[1] : got[2]]) == want


def test_against_brute_force(spark):
    """Every window of every item against every document by full alignment."""
    rng = random.Random(11)
    items = [(k, words(rng, 25)) for k in range(6)] + [(6, "Short item!"), (7, ""), (8, None), (9, words(rng, 60))]
    docs: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, "a short   ITEM, here"), (3, " Short.  ITEM"), (100, "shortitem")]
    for k in range(4, 90):
        text = words(rng, rng.randint(5, 60))
        item = rng.choice(items)[1]
        if item and k % 2:
            t = list(item.upper() if k % 3 else item)
            for _ in range(rng.randint(0, 8)):
                t[rng.randrange(len(t))] = rng.choice("xyz ")
            text = text + " " + "".join(t)[: rng.choice((90, 130, 400, 400))] + "%%% " + words(rng, 10)
        docs.append((k, text))
    got = {(r.doc_id, r.item_id): r.edits for r in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, text in docs:
        t = D.normalized(text)
        for i, item in items:
            n = D.normalized(item)
            if not n:
                continue
            if len(n) < D.LEAST:
                if n == t:
                    want[d, i] = 0
                continue
            for a in sorted({*range(0, max(1, len(n) - D.WINDOW + 1), D.WINDOW // 2), max(0, len(n) - D.WINDOW)}):
                w = n[a : a + D.WINDOW]
                e = edits(w, t)
                if e <= min(int(D.EDITS * len(w)), (len(w) - D.Q) // D.Q):
                    want[d, i] = min(e, want.get((d, i), 99))
    assert got == want and len(want) > 15 and (3, 6) in want


def test_short_items_do_not_delete_common_speech(spark):
    bench = spark.createDataFrame([(1, "Yes"), (2, "the United States"), (3, "4")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Well yes I think so"), (2, "Made in the United States, 4 of them."), (3, "YES!"), (4, None)], "doc_id long, text string")
    assert [r.doc_id for r in D.drop_contaminated(docs, bench).orderBy("doc_id").collect()] == [1, 2, 4]


@pytest.mark.parametrize("often", [32, 2])
def test_prompt_that_all_items_share(monkeypatch, often):
    """Windows with enough q-grams of their own need no common ones; what is found stays the same."""
    rng = random.Random(6)
    prompt = words(rng, 14)
    items = [(k, f"{words(rng, k % 9)} {prompt} {words(rng, 12)}") for k in range(60)]
    texts = [f"{words(rng, 9)} {i[1][a : a + 110]} {words(rng, 5)}" for i in items for a in (0, 40, 60)] + [prompt, words(rng, 80)]
    monkeypatch.setattr(D, "OFTEN", 10**9)
    plain = D.Index(items)
    monkeypatch.setattr(D, "OFTEN", often)
    index = D.Index(items)
    assert index.matches(texts) == plain.matches(texts)
    assert len(index.rows) < len(plain.rows) and len({m[0] for m in index.matches([prompt])[0]}) > 5


def test_passages_from_every_start():
    """A verbatim passage of the least length is found wherever it starts in its item."""
    rng = random.Random(4)
    items = [(k, words(rng, n)) for k, n in enumerate((18, 25, 45, 70))]
    index = D.Index(items)
    for k, item in items:
        for size in (75, 90, 100, 142):
            texts = [f"{words(rng, 20)} {item[a : a + size]} {words(rng, 20)}" for a in range(len(item) - size + 1)]
            assert all(k in {m[0] for m in found} for found in index.matches(texts))
    assert not any(index.matches([words(rng, 60) for _ in range(200)]))


def test_filter_agrees_and_keeps_columns(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("lang", "start"), spark.read.parquet(f"{sf}/benchmark.parquet")
    bad = {r.doc_id for r in D.contaminated(docs, bench).collect()}
    kept = D.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - bad
    held = {r.text for r in bench.collect()}
    assert not [r for r in kept.collect() if any(t in r.text for t in held)]


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "x y")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(docs, bench).count() == 0 and D.drop_contaminated(docs, bench).count() == 1
    assert D.contaminated(docs.limit(0), spark.createDataFrame([(1, "x y z " * 9)], bench.schema)).count() == 0


def test_index_in_pieces_gives_the_same(spark, sf, monkeypatch):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = sorted(map(tuple, D.contaminated(docs, bench).collect()))
    monkeypatch.setattr(D, "PIECE", 2000)
    monkeypatch.setattr(D, "PIECES", 3)
    assert sorted(map(tuple, D.contaminated(docs, bench).collect())) == whole and whole
    assert D.drop_contaminated(docs, bench).count() == docs.count() - len({r[0] for r in whole})


def test_very_long_text(spark):
    rng = random.Random(2)
    item = words(rng, 30)
    docs = spark.createDataFrame([(1, words(rng, 40_000) + " " + item + " " + words(rng, 40_000)), (2, words(rng, 40_000))], "doc_id long, text string")
    assert [(r.doc_id, r.edits) for r in D.contaminated(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()] == [(1, 0)]
