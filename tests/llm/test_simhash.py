from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from undula.llm import simhash as S


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def plain_fingerprint(text: str | None) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def made_texts(seed: int = 5) -> list[str | None]:
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    texts: list[str | None] = [None, "", " \t\n", "One two", "one TWO", "ÄÖ äö x y z", " a b c d e"]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((3, 30, 120, 400)))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 60))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    return texts + texts[:12]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k * 3 + 1, t, "x", k) for k, t in enumerate(made_texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, rep int"), {r[0]: r[1] for r in rows}


def test_fingerprints_and_components(docs):
    df, texts = docs
    got = {r["id"]: (r["fingerprint"], r["component"]) for r in S.simhash_groups(df).collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {i: f & (2**64 - 1) for i, (f, _) in got.items()} == prints
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    assert {i: c for i, (_, c) in got.items()} == components(prints, links)


@pytest.mark.parametrize("budget,leaf", [(0, 1), (2, 1), (4, 16), (7, 1024)])
def test_trie_links_are_complete(budget, leaf):
    rng = np.random.default_rng(budget)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    values = [int(b) ^ sum(1 << int(k) for k in rng.integers(0, 64, rng.integers(0, 6))) for b in base for _ in range(6)]
    values += [int(base[0]) ^ int(rng.integers(0, 1 << 12)) for _ in range(300)]
    v = np.unique(np.array(values, np.uint64))
    label = S.trie_links(v, np.array([0]), np.array([len(v)]), 0, budget, leaf=leaf)
    links = [(a, b) for a in range(len(v)) for b in np.flatnonzero(np.bitwise_count(v[a + 1 :] ^ v[a]) <= budget) + a + 1]
    want = components(range(len(v)), links)
    assert len({*zip(label.tolist(), want.values())}) == len(set(label.tolist())) == len(set(want.values()))


def test_hot_group_keeps_its_links(spark):
    """Many fingerprints that share their leading bits, and links that go across rotations."""
    rng = np.random.default_rng(3)
    prints = np.unique((rng.integers(0, 1 << 14, 800, dtype=np.int64)) | (np.int64(5) << 40))
    df = spark.createDataFrame([(k, int(p)) for k, p in enumerate(prints)], "rep long, fingerprint long")
    links = [(r.a, r.b) for r in S.hamming_links(df, max_bits=2).collect()]
    brute = [(a, int(b)) for a in range(len(prints)) for b in np.flatnonzero(np.bitwise_count((prints[a + 1 :] ^ prints[a]).view(np.uint64)) <= 2) + a + 1]
    assert components(range(len(prints)), links) == components(range(len(prints)), brute)


def test_hub_of_a_graph(spark, monkeypatch):
    """A hub's edges are joined by broadcast, others by shuffle; the components are the same."""
    from undula.llm import common

    monkeypatch.setattr(common, "hot_limit", lambda rows, least=256: 3)
    monkeypatch.setattr("undula.llm.components.hot_limit", lambda rows, least=256: 3)
    rng = random.Random(4)
    edges = [(0, k) for k in range(5, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(59, 150), (7, 8), (7, 7)]
    got = {r["node"]: r["component"] for r in S.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    assert got == components(nodes, [e for e in edges])
    rows = spark.createDataFrame([(k % 7 if k < 40 else 3, k) for k in range(90)] + [(None, 90)], "key int, v int")
    values = spark.createDataFrame([(k, f"n{k}") for k in range(5)], "key int, name string")
    for how, n in (("inner", 30 + 50), ("left", 91)):
        out = common.join_split(rows, values, ["key"], how=how).collect()
        assert len(out) == n and all(r["name"] == (f"n{r['key']}" if r["key"] is not None and r["key"] < 5 else None) for r in out)


def test_shared_tokens_streams_runs(spark):
    rows = [(t, k) for t, n in enumerate((1, 2, 1, 7, 1, 1, 3)) for k in range(n)]
    df = spark.createDataFrame(rows, "token long, rep long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        got = sorted(map(tuple, S.shared_tokens(df).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(x for x in rows if x[0] in (1, 3, 6))


def test_too_few_segments_are_refused(spark):
    df = spark.createDataFrame([(1, 1)], "rep long, fingerprint long")
    with pytest.raises(ValueError):
        S.hamming_links(df, max_bits=4, segments=4)


@pytest.mark.parametrize("block,pivots,salt,limit", [(512, 8, 4096, 4096), (3, 2, 2, 3)])
def test_near_duplicates_match_exact_similarity(docs, monkeypatch, block, pivots, salt, limit):
    """Also where groups and lists are cut into small blocks."""
    for name, v in (("BLOCK", block), ("PIVOTS", pivots), ("SALT", salt), ("LIST", limit)):
        monkeypatch.setattr(S, name, v)
    df, texts = docs
    got = {r["id"]: r["component"] for r in S.near_duplicates(df, words=5, similarity=0.8).collect()}
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    alike = lambda a, b: a == b or (a | b and len(a & b) / len(a | b) >= 0.8)
    links = [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])]
    assert got == components(sets, links)


def made_pairs(kinds):
    """Texts of n words and the same with the last k replaced, which are 0.8 alike for these n and k, among others."""
    rng = random.Random(9)
    rows, want = [], 0
    for copy in range(60):
        for n, k, more in kinds:
            base = [f"v{rng.randrange(10**9)}" for _ in range(n)]
            rows += [(2 * want, " ".join(base)), (2 * want + 1, " ".join(base[: n - k] + [f"u{rng.randrange(10**9)}" for _ in range(k + more)]))]
            want += 1
    return rows


@pytest.mark.parametrize("limit", [4096, 3])
def test_pairs_just_at_the_similarity(spark, monkeypatch, limit):
    """4 shingles against 5, and 9 or 45 of which one or 5 differ on either side: exactly 0.8; none is lost."""
    monkeypatch.setattr(S, "LIST", limit, raising=False)
    rows = made_pairs([(8, 0, 1), (13, 1, 0), (49, 5, 0)])
    rows += [(10_000 + k, f"a common text that very many others hold too and tell at length so it is {k}") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r["component"] for r in S.near_duplicates(df).collect()}
    assert got == {i: 10_000 if i >= 10_000 else i - i % 2 for i in got} and len(got) == len(rows)


def test_drop_keeps_one_of_each_group_and_all_columns(docs):
    df, _ = docs
    groups = {r["id"]: r["component"] for r in S.near_duplicates(df).collect()}
    kept = S.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == set(groups.values())


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.simhash_groups(empty).count() == 0
    assert S.drop_near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "z")], "doc_id long, text string")
    got = sorted((r["id"] is None, r["component"]) for r in S.simhash_groups(odd).filter("component IS NOT NULL").collect())
    assert got == [(False, 4), (False, 4), (True, 4)]
    assert S.simhash_groups(odd).count() == 4
    assert S.drop_near_duplicates(odd).count() == 4


def test_one_row_stays_where_ids_repeat_or_are_null(spark):
    import corpus_pipeline

    text = "a b c d e f"
    rows = [(None, text), (4, text), (4, text), (None, "z"), (None, "z"), (7, "y"), (7, "x"), (None, "A  b c d e F")]
    kept = corpus_pipeline.near_dups_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert kept.columns == ["doc_id", "text"]
    assert sorted(((r.doc_id or 0), r.text) for r in kept.collect()) == [(0, "z"), (4, text), (7, "x"), (7, "y")]


def test_very_long_text(spark):
    rng = random.Random(1)
    long = " ".join(rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(90_000))
    got = S.simhash_groups(spark.createDataFrame([(1, long), (2, long + " end")], "doc_id long, text string")).collect()
    assert {r["component"] for r in got} == {1}
    assert {r["id"]: r["fingerprint"] & (2**64 - 1) for r in got}[1] == plain_fingerprint(long)


def test_parities_bound_the_difference_after_folding():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 5, 60, 64, 65, 100, 127, 129, 200, 900, 9000, 16000)]
    sets += [np.unique(np.concatenate([x[: len(x) * 9 // 10], rng.integers(0, 2**63, 1 + len(x) // 20, dtype=np.uint64)])) for x in sets]
    w = S._Parities([S.parities(x) for x in sets])
    assert len(S.parities(np.zeros(0, np.uint64))) == 8 and set(w.words) >= {1, 2, 4, 128}
    pairs = [(a, b) for a in range(len(sets)) for b in range(len(sets)) if max(w.words[a], w.words[b]) <= 2 * min(w.words[a], w.words[b])]
    a, b = np.array(pairs).T
    for (x, y), bits in zip(pairs, w.differ(a, b)):
        apart = len(np.setxor1d(sets[x], sets[y]))
        assert bits <= apart and bits % 2 == apart % 2
    low = S._Parities([S.parities(np.sort(x.astype(np.uint32))) for x in sets])
    assert all((p == q).all() for p, q in zip(w.rows, low.rows))
