from __future__ import annotations

import random
import re
from collections import defaultdict

from undula.llm.mixing import mix_sources


def water_fill(sizes: dict, weights: dict, cap: float) -> dict:
    """The resharing loop, step by step."""
    target = dict.fromkeys(sizes, 0.0)
    left, open_ = float(sum(sizes.values())), {s for s in sizes if sizes[s] > 0}
    while left > 1e-9 and open_:
        total = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / total for s in open_}
        full = {s for s in open_ if target[s] + share[s] >= cap * sizes[s]}
        if not full:
            for s in open_:
                target[s] += share[s]
            break
        # a source that is full takes its cap; the rest is shared anew
        for s in full:
            left -= cap * sizes[s] - target[s]
            target[s] = cap * sizes[s]
        open_ -= full
    return target


def made(seed: int):
    rng = random.Random(seed)
    rows = []
    for s in [None, "a", "b", "é", "z", "empty", "tiny"]:
        n = {"a": 400, "b": 30, "empty": 3, "tiny": 1}.get(s, 60)
        for _ in range(n):
            rows.append((len(rows), " ".join("w" for _ in range(0 if s == "empty" else rng.randint(0, 60))), s, "clash", -1))
    rows.append((len(rows), None, "a", None, None))
    return rows + rows[:2]


def test_targets_and_words(spark):
    for seed in range(2):
        rows = made(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string, source string, target string, _last int")
        out = mix_sources(df)
        got = out.collect()
        assert len(got) == len(rows)
        size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
        sizes = defaultdict(int)
        for r in rows:
            sizes[r[2]] += size[r[0]]
        order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
        weights = {s: k % 3 + 1 for k, s in enumerate(order)}
        want = water_fill(sizes, weights, 3)
        taken = defaultdict(int)
        for r in got:
            assert r["size"] == size[r.doc_id] and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r["size"] and r.taken % max(r["size"], 1) == 0
            assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
            taken[r.source] += r.taken
        for s in sizes:
            assert abs(taken[s] - want[s]) <= 61  # within a document
        assert sorted(map(str, mix_sources(df.repartition(3)).collect())) == sorted(map(str, got))


def test_empty_and_all_empty(spark):
    schema = "doc_id long, text string, source string"
    assert mix_sources(spark.createDataFrame([], schema)).count() == 0
    got = mix_sources(spark.createDataFrame([(1, "", "a"), (2, None, None)], schema)).collect()
    assert [(r.taken, r.target) for r in got] == [(0, 0.0)] * 2


def test_long_text_and_white_space(spark):
    schema = "doc_id long, text string, source string"
    got = mix_sources(spark.createDataFrame([(1, "a b\tc\x0bd\n" * 100_000, "a")], schema)).first()
    assert (got["size"], got.target, got.taken) == (300_000, 300_000.0, 300_000)
