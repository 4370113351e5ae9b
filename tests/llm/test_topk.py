from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from undula.llm import topk as T


def brute(rows, k, of=lambda i: i % 20 == 0):
    usable = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i in {i for i, _ in usable if of(i)}:
        q = min(v for j, v in usable if j == i)
        scored = sorted(((-sum(a * b for a, b in zip(q, v)), j) for j, v in usable if j != i))[:k]
        out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)}
    return out


def run(spark, data, k, **options):
    df = spark.createDataFrame([(i, v, "clash") for i, v in data], "vec_id long, embedding array<double>, lane string")
    v = df.select(F.col("vec_id").alias("id"), T.quantized(F.col("embedding"), 64).alias("v"))
    return [tuple(r) for r in T.top_k(v.filter("id % 20 = 0"), v, k, **options).collect()]


@pytest.mark.parametrize("scale,dim,rows", [(1.0, 8, 16), (1.0, 64, 7), (4000.0, 6, 50)])
def test_against_brute_force(spark, scale, dim, rows):
    rng = random.Random(dim)
    data = [(i, [rng.gauss(0, scale) for _ in range(dim)]) for i in range(150)]
    data += [(200 + i, data[0][1]) for i in range(60)]  # ties
    data += [(300, None), (320, [1.0, None] * (dim // 2)), (340, [float("nan")] * dim), (360, [float("inf")] * dim), (None, data[3][1])]
    for k in (1, 20):
        got = run(spark, data, k, rows=rows)
        assert len(got) == len(set(got)) and set(got) == brute(data, k)


def test_scores_beyond_exact_floats(spark):
    data = [(i, [2.0**21 + i * 0.25, 2.0**21 - i * 0.5, 1.0]) for i in range(45)]
    assert set(run(spark, data, 5)) == brute(data, 5)


def test_few_candidates_and_empty(spark):
    data = [(0, [0.5, 0.25]), (20, [0.25, -1.0]), (3, [0.0, 0.0])]
    assert set(run(spark, data, 20)) == brute(data, 20)
    assert run(spark, [(0, [1.0])], 20) == []
    assert run(spark, [], 20) == [] and run(spark, [(7, [1.0])], 20) == []


def test_query_against_brute_force(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert {tuple(r) for r in T.op9_topk(spark, sf).collect()} == brute(rows, 20)
