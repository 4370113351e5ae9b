from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from undula.llm import spelling as S


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long_ = sorted((a, b), key=len)
    return len(long_) == len(short) + 1 and any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_)))


def brute(counts, factor=10):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= factor * counts[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts}


def counted(rows):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def variants(spark, counts, **sizes):
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    near = {(r["word"], r["n_near"], r["form"], r["form_n"]) for r in S.near_words(words, **sizes).collect()}
    return near, [tuple(r) for r in S.spelling_variants(words).collect()]


@pytest.mark.parametrize("letters,sizes", [("ab", {}), ("aabéÿ", {"shard_words": 40, "pass_bytes": 4000}), ("abc", {"shard_bytes": 200, "pass_bytes": 1})])
def test_against_brute_force(spark, letters, sizes):
    rng = random.Random(len(letters))
    counts = {"".join(rng.choice(letters) for _ in range(rng.randint(7, 11))): rng.choice([2, 2, 3, 25, 300, 4000]) for _ in range(250)}
    near, rows = variants(spark, counts, **sizes)
    assert {(w, k) for w, k, _, _ in near} == {(w, k) for w, _, _, _, k, _ in brute(counts)}
    assert near == {(w, len(v), *(min(((-counts[x], x) for x in v))[::-1] if v else (None, None))[:1], max((counts[x] for x in v), default=None)) for w in counts for v in [[x for x in counts if one_edit(w, x)]]}
    assert len(rows) == len(set(rows)) and set(rows) == brute(counts)


def test_long_chains_ties_and_long_words(spark):
    counts = {"aaaaaaa" + "b" * k: 2 * 10**k for k in range(12)}
    counts |= {"zzzzzzzx": 50, "zzzzzzzy": 50, "zzzzzzz": 5, "c" * 5000: 20, "c" * 5001: 2, "d" + "c" * 4999: 2, "aloneéé": 2}
    _, rows = variants(spark, counts)
    assert len(rows) == len(set(rows)) and set(rows) == brute(counts)


def query(spark, rows, tmp_path, name="documents"):
    spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n long").write.parquet(f"{tmp_path}/{name}.parquet")
    return [tuple(r) for r in S.op11_spelling(spark, str(tmp_path)).collect()]


def test_query_against_brute_force(spark, sf, tmp_path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(None, "Straßenbahn Straßenbahn NAIVETÉ naivetÉ ××××××××"), (3, None), (3, ""), rows[0], rows[0], (5, "\U0001d4b6bcdefgh bcdefgh́ bcdefgh")]
    rows.append((9, "x" * 300_000 + " " + "y" * 7))
    found = query(spark, rows, tmp_path)
    counts = counted(rows)
    # Brute force over all pairs is slow: pairs meet by equal letters around one place.
    assert {(w, n) for w, _, _, n, _, _ in found} == set(counts.items())
    some = random.Random(1).sample(sorted(counts), 150)
    by = {f[0]: f for f in found}
    for w in some:
        near = [v for v in counts if abs(len(v) - len(w)) < 2 and one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best and counts[best] >= 10 * counts[w] else None
        assert by[w][1] == form and by[w][4:] == (len(near), counts[form] if form else None)


def test_empty(spark, tmp_path):
    assert query(spark, [], tmp_path) == []
    assert query(spark, [(1, None), (2, "short words only")], tmp_path / "b") == []
    with pytest.raises(ValueError):
        S.spelling_variants(spark.createDataFrame([("abcdefg", 2)], "word string, n long"), factor=1)
