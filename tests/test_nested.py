"""Rewriting of JSON documents against a plain recursion over the parsed document."""

from __future__ import annotations

import json
import random

from undula.operators.index import requested_missing, walked
from undula.operators.nested import strip_paths

KNOWN = {"/srv/a.wav": "a", '/srv/q"uo\\te.wav': 'q"\\', "/srv/é\n.wav": "é", "": "empty", "7": "seven"}


def plain(value):
    if isinstance(value, dict):
        return {k: KNOWN[v] if k == "path" and isinstance(v, str) and v in KNOWN else plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, list) else value


def made(rng: random.Random, depth: int):
    kind = rng.randrange(6) if depth else 5
    if kind < 3:
        return {rng.choice(["path", "path", "file", 'a"b', "{", "pathe"]): made(rng, depth - 1) for _ in range(rng.randrange(4))}
    if kind == 3:
        return [made(rng, depth - 1) for _ in range(rng.randrange(4))]
    return rng.choice([*KNOWN, "/srv/other.wav", 7, None, True, '{"path":"/srv/a.wav"}', ',"path":', "\\", '"', "x,", "path", "\u0001\u0002"])


def test_any_depth(spark):
    rng = random.Random(5)
    docs = [json.dumps(made(rng, 6), ensure_ascii=k % 2 == 0) for k in range(400)]
    docs += ['{"pa\\u0074h": "\\/srv\\/a.wav"}', '{ "path" :\n"/srv/a.wav" }', "no json", "", '{"path":"/srv/a.wav"', None, '{"path":"' + "\\\\" * 50_000 + '"}', docs[0]]
    table = spark.createDataFrame(list(enumerate(docs)), "id int, doc string")
    mapping = spark.createDataFrame([*KNOWN.items(), ("/srv/a.wav", "b"), (None, "c"), ("/srv/other.wav", None)], "path string, shown string")
    got = {r.id: r.stripped for r in strip_paths(table, "doc", mapping).collect()}
    assert len(got) == len(docs)
    for k, doc in enumerate(docs):
        try:
            want = plain(json.loads(doc or "x"))
        except ValueError:
            assert got[k] == doc
        else:
            assert json.loads(got[k]) == want


def test_a_small_mapping_needs_no_shuffle(spark):
    rng = random.Random(8)
    table = spark.createDataFrame([(k, json.dumps(made(rng, 5))) for k in range(200)] + [(200, "no json"), (201, None), (202, '{"path":"/srv/a.wav"}'), (203, '{"path":"/srv/a.wav"}')], "id int, doc string")
    mapping = spark.createDataFrame(list(KNOWN.items()), "path string, shown string")
    looked_up = strip_paths(table, "doc", mapping)
    assert "Exchange" not in looked_up._jdf.queryExecution().executedPlan().toString()
    joined = strip_paths(table, "doc", mapping, most=1)
    assert {r.id: r.stripped for r in looked_up.collect()} == {r.id: r.stripped for r in joined.collect()}


def test_empty_and_repeated(spark):
    mapping = spark.createDataFrame([], "path string, shown string")
    one = spark.createDataFrame([("{}",), ("{}",), ('{"path":"x"}',), ('{"path":"x"}',)], "doc string").selectExpr("doc", "doc AS path", "1 AS shown")
    assert sorted(r.stripped for r in strip_paths(one, "doc", mapping).collect()) == ['{"path":"x"}'] * 2 + ["{}"] * 2
    assert strip_paths(one.limit(0), "doc", mapping).count() == 0


def test_folder_order(spark):
    paths = ["b/z.wav", "a.wav", "b/a/x.wav", "b/b.wav", "B.wav", "a/1.wav", ".h/x.wav", "b/.x.wav", "a.d/2.wav", None]
    table = spark.createDataFrame([(p,) for p in paths], "path string")
    want = ["B.wav", "a.wav", "a/1.wav", "a.d/2.wav", "b/b.wav", "b/z.wav", "b/a/x.wav"]
    for limit in (3, 7, 20):
        rows, more = walked(table, limit)
        assert [r.path for r in rows.orderBy("place").collect()] == want[:limit] and more.first().truncated == (limit < 7)


def test_missing_keys(spark):
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "k int")
    assert [r.k for r in requested_missing(rows(1, 1, 2, None, 3), rows(None, 2), "k").orderBy("k").collect()] == [1, 3]
