from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from undula.llm import chat as C

TEXTS = ["", "hi", "[INST] x [/INST]", "</s>[INST] ok [/INST]", "\\", "\\[", "[\\", "<\\<", "\\\\[[<<", "a\nb", " [/ASST]", "é😀[", "<", "[", "[ASST] \\ [/ASST]</s>", "x" * 100_000 + "["]


def test_read_back_of_any_text(spark):
    rows = [(1, k, r, t) for k, (r, t) in enumerate((r, t) for t in TEXTS for r in ("user", "assistant", "system", "tool [x]", ""))]
    turns = spark.createDataFrame([(c, k, 0, "turn", r, t) for c, k, r, t in rows], C.TURNS.replace("conv_id string", "conv_id long").replace("turn string", "turn long"))
    out = C.format_conversations(turns).collect()
    assert len(out) == 1
    assert C.parse(out[0].formatted) == [(r, t) for _, _, r, t in rows]
    assert [C.unescape(out[0].formatted[s.start : s.end]) for s in out[0].loss] == [t for _, _, r, t in rows if r == "assistant"]
    inside = spark.createDataFrame([(t,) for t in TEXTS], "t string").select(C.escape(F.col("t")).alias("e")).collect()
    assert not [r.e for r in inside if any(m in r.e for m in ("[INST", "[/", "</s", "[ASST"))]


LAYOUT_CASES = [
    ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]}, [("system", "s"), ("user", "u")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, [("user", "q"), ("assistant", "a")]),
    ({"prompt": "p", "response": "r"}, [("user", "p"), ("assistant", "r")]),
    ({"prompt": "p", "completion": "r"}, [("user", "p"), ("assistant", "r")]),
    ({"instruction": "i", "input": "x", "output": "o"}, [("user", "i\n\nx"), ("assistant", "o")]),
    ({"output": "o", "input": "", "instruction": "i"}, [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "output": None}, [("user", "i")]),
    ({"system": "s", "instruction": "i", "input": None, "output": "o"}, [("system", "s"), ("user", "i"), ("assistant", "o")]),
    ({"question": "q", "answer": "a"}, [("user", "q"), ("assistant", "a")]),
    ({"context": "c", "question": "q", "answer": "a"}, [("user", "c\n\nq"), ("assistant", "a")]),
    ({"role": "user", "text": "t"}, [("user", "t")]),
    ({"prompt": 5, "response": "x", "id": 3}, [("user", "5"), ("assistant", "x")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "u"}], "name": "n"}]}, [("user", '[{"text": "u", "type": "text"}]')]),
    ({"messages": []}, []),
    ({"conversations": [{"from": "gpt", "value": None}, {"from": None, "value": True}], "meta": {"a": [1]}}, [("assistant", ""), ("", "true")]),
]


@pytest.mark.parametrize("record,want", LAYOUT_CASES)
def test_layouts(record, want):
    layout, turns = C.turns_of(record)
    assert layout and turns == want


def test_fingerprints_tell_layouts_apart():
    assert len(C.BY_FINGERPRINT) == len(C.LAYOUTS) + 2
    assert C.turns_of({"messages": [{"role": "u", "content": "c"}, 7]}) == (None, []) and C.turns_of({"messages": None}) == (None, []) and C.turns_of(None) == (None, [])
    assert C.field_paths({"a": [{"b": 1}, {"c": {"d": None}}]}) == {"a[]", "a[].b", "a[].c.d"}
    assert C.turns_of({"what": 1}) == (None, []) and C.turns_of([1]) == (None, []) and C.turns_of("x") == (None, [])


def test_records_table(spark):
    rows = [(k, json.dumps(r), "clash") for k, (r, _) in enumerate(LAYOUT_CASES)] + [(90, '{"what": 1}', ""), (91, None, ""), (92, '{"prompt": "p", "resp', ""), (93, "[" * 100_000, ""), (None, '{"prompt": "p", "response": "r"}', "")]
    out = C.canonical_turns(spark.createDataFrame(rows, "conv_id long, payload string, layout string")).collect()
    for k, (_, want) in enumerate(LAYOUT_CASES):
        assert [(r.role, r.text) for r in sorted((r for r in out if r.conv_id == k), key=lambda r: r.part)] == (want or [(None, None)])
    assert [(r.conv_id, r.layout, r.role) for r in out if r.conv_id in (90, 91, 92, 93)] == [(k, None, None) for k in (90, 91, 92, 93)]
    assert len([r for r in out if r.conv_id is None]) == 2
    counts = {r.layout: (r.without_turns, r.turns) for r in C.layout_counts(C.canonical_turns(spark.createDataFrame(rows, "conv_id long, payload string, layout string"))).collect()}
    assert counts[None] == (4, 0) and counts["messages"] == (1, 3) and counts["prompt"] == (0, 6)


def test_query_against_plain_python(spark, tmp_path):
    rows = [(1, 0, "user", "a[b"), (1, 1, "assistant", None), (1, 1, "assistant", "x"), (2, 5, None, "n"), (2, 3, "assistant", "é"), (2, 3, "assistant", "é"), (None, 0, "user", "z"), (2**60 + 1, 0, "tool", "t")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in C.op8_chat(spark, str(tmp_path)).collect()}
    rows += [(-1, 0, "user", C.SAID), (-1, 1, "assistant", C.SAID)]
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        turns = [(a or "", b or "") for _, _, a, b in sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1], x[2] or "", x[3] or ""))]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert [r.conv_id for r in C.op8_chat(spark, str(tmp_path)).collect()] == [-1]
    assert C.canonical_turns(spark.createDataFrame([], "conv_id long, payload string")).count() == 0
