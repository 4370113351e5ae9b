from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from undula.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<double>, label int, entry string, n int"


def brute(rows, parts=8, entries=16, rounds=6):
    """Plain Lloyd over (id, vector, label)."""
    kept = [(i, [math.floor(4096 * x) for x in v], y) for i, v, y in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    size = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    cut = [[(v + [0] * (parts * size - len(v)))[p * size : (p + 1) * size] for p in range(parts)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    book = [[cut[k][p] for k in order] for p in range(parts)]

    def near():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e)), j) for j, e in enumerate(book[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        found = near()
        for p in range(parts):
            for j in range(len(order)):
                own = [c[p] for c, f in zip(cut, found) if f[p][1] == j]
                if own:
                    book[p][j] = [sum(x) // len(own) for x in zip(*own)]
    found = near()
    error = [sum(d for d, _ in f) for f in found]
    by = {}
    for (_, _, y), e in zip(kept, error):
        by[y] = by.get(y, 0) + e
    sha = hashlib.sha256(",".join(str(x) for p in book for e in p for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{j:02x}" for _, j in f), e, by[y], sha) for (i, _, y), f, e in zip(kept, found, error)), key=repr)


def run(spark, rows, tmp_path, name):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    df.write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
    return sorted((tuple(r) for r in V.op12_vector_codes(spark, f"{tmp_path}/{name}").collect()), key=repr)


def test_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.1) for _ in range(16)], rng.choice([0, 1, None, -7])) for i in range(120)]
    grid = [(i, [rng.choice([-0.25, 0.0, 0.25]) for _ in range(24)], i % 3) for i in range(90)]  # ties everywhere
    odd = rows[:40] + rows[:5] + [(None, rows[3][1], None), (50, None, 1), (51, [], 1), (52, [0.5, None] * 8, 1), (53, [float("nan")] + [0.0] * 15, 1), (54, [float("inf")] * 16, 1), (0, [-1.0] * 16, 0), (60, [0.5] * 13, 0), (61, [-0.00001] * 20, 2)]
    for name, data in (("rows", rows), ("grid", grid), ("odd", odd), ("few", rows[:5]), ("one", rows[:1]), ("same", [(i, [0.5] * 8, 1) for i in range(30)])):
        assert run(spark, data, tmp_path, name) == brute(data), name


def test_bounds_save_scans_and_change_nothing(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, (16, 4, 3))
    x = centres[np.arange(600) % 16].reshape(600, 12) + rng.integers(-40, 40, (600, 12))
    df = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(x)], "id long, label string, v array<long>")
    codes, book, scans = V.quantize(df, parts=4, entries=16, rounds=6, rows=100)
    assert codes.count() == 600 and sum(scans) < 7 * 600 * 4 / 2
    for p in range(4):
        assert (np.array([[int(r["code"][2 * p : 2 * p + 2], 16)] for r in codes.orderBy("id").collect()])[:, 0] == V._distances(x.reshape(600, 4, 3)[:, p], book[p]).argmin(1)).all()


def test_empty_and_too_large(spark, tmp_path):
    assert run(spark, [], tmp_path, "empty") == []
    assert run(spark, [(1, None, 1), (2, [None], None)], tmp_path, "nulls") == []
    with pytest.raises(Exception, match="too large"):
        run(spark, [(1, [1e9], 1)], tmp_path, "large")


def test_query_against_brute_force(spark, sf):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in V.op12_vector_codes(spark, sf).collect()), key=repr) == brute(rows)
