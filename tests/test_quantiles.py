from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula.operators import quantiles as Q

PROBABILITIES = [0.0, 0.1, 0.5, 0.9, 0.95, 1.0]


def rows_of():
    rng = random.Random(6)
    out = [("even", 0, rng.random()) for _ in range(701)]
    out += [("wide", 0, rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300)) for _ in range(600)]
    out += [("ties", 1, float(rng.choice([1, 2, 2, 3]))) for _ in range(500)]
    out += [("one value", 1, 7.25)] * 400
    out += [("close", 0, 1.0 + k * 2.0**-52) for k in range(450)]
    out += [("small", 0, float(k)) for k in range(10)] + [("null", 0, None)] * 20 + [("some nulls", 2, v) for v in [None, 3.0, 1.0, 2.0] * 100]
    out += [(None, 0, float(k % 37)) for k in range(300)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("most,few", [(10**6, 10), (50, 10), (50, 1), (0, 4096)])
def test_against_numpy(spark, most, few):
    rows = rows_of()
    df = spark.createDataFrame(rows, "g string, h int, x double").repartition(5)
    keyed = df.withColumn("g", F.coalesce("g", F.lit("none")))
    got = {(r["g"], r["h"]): r["q"] for r in Q.grouped_quantiles(keyed, ["g", "h"], F.col("x"), PROBABILITIES, most=most, few=few).collect()}
    want = {}
    for g, h, x in rows:
        want.setdefault((g or "none", h), []).extend([] if x is None else [x])
    assert got.keys() == want.keys()
    for k, v in want.items():
        if v:
            s = sorted(v)
            at = [p * (len(s) - 1) for p in PROBABILITIES]
            exact = [s[int(a)] if a == int(a) else (int(a) + 1 - a) * s[int(a)] + (a - int(a)) * s[int(a) + 1] for a in at]
            np.testing.assert_allclose(got[k], exact, rtol=1e-15)
        else:
            assert got.get(k) is None


def test_median_of_hot_group(spark):
    df = spark.range(30_000).select((F.col("id") % 3 == 0).alias("hot"), (F.hash("id") % 1000 / 7.0).alias("x")).withColumn("hot", F.when(F.col("hot"), -1).otherwise((F.hash("x") % 50)))
    got = {r["hot"]: r["m"] for r in Q.grouped_median(df, ["hot"], F.col("x"), "m", most=2000, few=100).collect()}
    want = {r["hot"]: r["m"] for r in df.groupBy("hot").agg(F.percentile("x", 0.5).alias("m")).collect()}
    assert got == want


def test_empty(spark):
    assert Q.grouped_median(spark.createDataFrame([], "g int, x double"), ["g"], F.col("x"), "m").count() == 0
