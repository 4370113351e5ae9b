"""The offset search by blocks of columns against plain rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula.operators import audio as AU
from undula.operators import frames as FR
from undula.operators import pairs as PR


def columns(spark, n, bins, seed, lost=()):
    v = np.random.default_rng(seed).normal(size=(n, bins))
    return spark.createDataFrame([("f", c, [float(x) for x in v[c]]) for c in range(n) if c not in lost], "file string, col long, v array<double>")


@pytest.mark.parametrize("first, last", [(-3, 9), (12, 20), (-30, -25)])
def test_lags_by_blocks(spark, first, last):
    a, b = columns(spark, 50, 5, 1, lost=(7,)), columns(spark, 43, 5, 2, lost=(0, 30))
    asked = b.withColumns({"_from": F.lit(first), "_to": F.lit(last), "_least": F.lit(8)})
    got = {r.lag: r for r in PR.block_lag_scores(a, asked, "file", block=16).collect()}
    rows = lambda df: df.select("file", "col", F.posexplode("v").alias("bin", "db"))
    want = {r.lag: r for r in PR.lag_scores(rows(a), rows(b), range(-50, 50), "file", least=8).collect()}
    asked_for = {*range(first, last + 1), 0}
    assert asked_for & set(want) <= set(got)
    for lag in asked_for & set(want):
        assert got[lag].cols == want[lag].cols and got[lag].score == pytest.approx(want[lag].score, abs=1e-9)


def test_what_is_sent_does_not_grow_with_the_lags(spark):
    a = columns(spark, 200, 3, 3)
    asked = a.withColumns({"_from": F.lit(-40), "_to": F.lit(40), "_least": F.lit(8)})
    plan = PR.block_lag_scores(a, asked, "file", block=64)._jdf.queryExecution().optimizedPlan().toString()
    # rows are made for blocks only, before the join; a lag has no row of its own until its sums are known
    assert "explode(sequence" not in plan.split("Join")[0].split("met(")[0]
    assert {r.lag for r in PR.align_columns(a, a.withColumn("col", F.col("col") - 11).filter("col >= 0"), "file").collect()} == {11}


def test_a_frame_does_not_carry_its_chunk(spark):
    table = spark.createDataFrame([("f", 0, k, 8000, [float(v) for v in range(k * 64, k * 64 + 64)]) for k in range(3)], "file string, ch int, chunk long, sr int, x array<float>")
    framed = FR.hop_frames(table, 16, 8, 64)
    assert [r.x for r in framed.orderBy("frame").collect()] == [[float(v) for v in range(k * 8, k * 8 + 16)] for k in range(23)]
    made = next(line for line in AU.stft(framed)._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate " in line)
    assert "inline(" in made and "explode(sequence" not in made
