"""Chat formatting by schema fingerprints.

A record's fingerprint is a hash of its nested field paths, of those that some
mapping knows.  It selects one of the declarative mappings below, which turn prompt, instruction and message
layouts into canonical turns (role, text).  New layouts need a new entry, no
code.  Turns are then rendered one by one with marks for each turn; control
strings inside texts are escaped reversibly, so the output can be read back.

    [INST] user text [/INST]   [ASST] assistant text [/ASST]</s>   [SYS] .. [/SYS]   [ROLE:name] .. [/ROLE]

Inside texts ``\\`` becomes ``\\\\`` and every ``<`` and ``[`` is followed by a
``\\``, so no control string can occur in one.

Defined results: a null text is the empty text, a null role the empty role; a value
that is no text stands as its JSON; fields that no mapping knows are left aside;
turns of one conversation go by turn, then role, then text, repeated rows stay.  A
record without a mapping, without turns or that is no JSON gives one row with role
and text null (``layout_counts`` counts them; none is guessed).  An empty table
gives an empty result; other columns are left aside.  A conversation's digest is a
running one, so its rows stream through one task, in order and without being held.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "conv_id string, turn string, part int, layout string, role string, text string"


def field_paths(value, at: str = "") -> set[str]:
    """Paths of all leaves; items of a list share a path."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union({f"{at}[]"}, *(field_paths(v, f"{at}[]") for v in value))
    return {at}


def fingerprint(paths) -> str:
    return hashlib.blake2b("\n".join(sorted(paths)).encode(), digest_size=8).hexdigest()


_SAID = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _list(name: str, role: str, text: str) -> dict:
    return {"paths": [f"{name}[]", f"{name}[].{role}", f"{name}[].{text}"], "list": name, "role": role, "text": text, "roles": _SAID}


def _fields(**roles: str) -> dict:
    """role=field, or role=several fields joined by an empty line; empty fields give no turn."""
    return {"paths": [p for f in roles.values() for p in f.split("+")], "fields": list(roles.items())}


#: Declarative mappings; the fingerprint of ``paths`` is the key under which a layout is found.
LAYOUTS = {
    "turn": {"paths": ["role", "text"], "list": None, "role": "role", "text": "text", "roles": {}},
    "messages": _list("messages", "role", "content"),
    "conversations": _list("conversations", "from", "value"),
    "prompt": _fields(user="prompt", assistant="response"),
    "completion": _fields(user="prompt", assistant="completion"),
    "instruction": _fields(user="instruction+input", assistant="output"),
    "instruction_plain": _fields(user="instruction", assistant="output"),
    "instruction_system": _fields(system="system", user="instruction+input", assistant="output"),
    "question": _fields(user="question", assistant="answer"),
    "question_context": _fields(user="context+question", assistant="answer"),
}
BY_FINGERPRINT = {fingerprint(m["paths"]): name for name, m in LAYOUTS.items()}
BY_FINGERPRINT |= {fingerprint([f"{m['list']}[]"]): name for name, m in LAYOUTS.items() if m.get("list")}  # lists without items
KNOWN = frozenset(p for m in LAYOUTS.values() for p in m["paths"])


def as_text(value) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False, sort_keys=True)


def known_paths(record) -> set[str]:
    """Paths of the record's leaves that a mapping knows; what lies below a known leaf counts as that leaf."""
    out = set()
    for p in field_paths(record):
        while p and p not in KNOWN:
            p = p[:-2] if p.endswith("[]") else p.rpartition(".")[0]
        out |= {p} if p else set()
    return out


def turns_of(record) -> tuple[str | None, list[tuple[str, str]]]:
    """(layout, turns) of one parsed record; layout None: no mapping has its fingerprint."""
    layout = BY_FINGERPRINT.get(fingerprint(known_paths(record))) if isinstance(record, dict) else None
    if layout is None:
        return None, []
    m = LAYOUTS[layout]
    if "fields" in m:
        texts = [(role, "\n\n".join(t for t in (as_text(record[p]) for p in f.split("+")) if t)) for role, f in m["fields"]]
        return layout, [(r, t) for r, t in texts if t]
    items = [record] if m["list"] is None else record[m["list"]]
    if not all(isinstance(item, dict) for item in items):
        return None, []
    return layout, [(m["roles"].get(r := as_text(item.get(m["role"])), r), as_text(item.get(m["text"]))) for item in items]


def _parsed(payload: str | None):
    try:
        return json.loads(payload) if payload else None
    except (ValueError, RecursionError):
        return None


def _canonical(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for conv, turn, payload in zip(batch["conv_id"], batch["turn"], batch["payload"]):
            layout, turns = turns_of(_parsed(payload))
            rows += [(conv, turn, k, layout, role, text) for k, (role, text) in enumerate(turns)] or [(conv, turn, 0, layout, None, None)]
        yield pd.DataFrame(rows, columns=["conv_id", "turn", "part", "layout", "role", "text"])


def canonical_turns(records: DataFrame, *, conv_col: str = "conv_id", order_col: str | None = None, payload_col: str = "payload") -> DataFrame:
    """JSON records of any known layout -> a row for each canonical turn."""
    order = F.col(order_col).cast("string") if order_col else F.lit("0")
    turns = records.select(F.col(conv_col).cast("string").alias("conv_id"), order.alias("turn"), F.col(payload_col).alias("payload")).mapInPandas(_canonical, TURNS)
    return turns.withColumns({c: F.col(c).cast("long") for c in ("conv_id", "turn")})  # as text on the way: nulls would make pandas round whole numbers


def layout_counts(turns: DataFrame) -> DataFrame:
    """(layout, records without turns, turns); layout null: no mapping."""
    return turns.groupBy("layout").agg(F.count_if(F.col("role").isNull()).alias("without_turns"), F.count("role").alias("turns"))


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("<"), F.lit("<\\")), F.lit("["), F.lit("[\\"))


_ESCAPED = re.compile(r"<\\|\[\\|\\\\")
_TURN = re.compile(r"\[(INST|ASST|SYS|ROLE)(?::([^\]]*))?\] (.*?) \[/\1\](?:</s>)?", re.DOTALL)
_ROLES = {"INST": "user", "ASST": "assistant", "SYS": "system"}


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0], text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of formatted text."""
    return [(_ROLES.get(m[1]) or bytes.fromhex(m[2] or "").decode(), unescape(m[3])) for m in _TURN.finditer(formatted)]


def render_turns(turns: DataFrame) -> DataFrame:
    """Add ``segment`` and, for assistant turns, the span of the text in it (``loss_start``, ``loss_end``; code points).

    The formatted conversation is its segments in order, nothing between; other roles' names are written as hex.
    """
    role = F.coalesce("role", F.lit(""))
    opening = (
        F.when(role == "user", F.lit("[INST] ")).when(role == "assistant", F.lit("[ASST] ")).when(role == "system", F.lit("[SYS] "))
        .otherwise(F.concat(F.lit("[ROLE:"), F.hex(role.cast("binary")), F.lit("] ")))
    )
    closing = F.when(role == "user", F.lit(" [/INST]")).when(role == "assistant", F.lit(" [/ASST]</s>")).when(role == "system", F.lit(" [/SYS]")).otherwise(F.lit(" [/ROLE]"))
    said = escape(F.coalesce("text", F.lit("")))
    loss = role == "assistant"
    return turns.withColumn("segment", F.concat(opening, said, closing)).withColumn("loss_start", F.when(loss, F.length(opening))).withColumn("loss_end", F.when(loss, F.length(opening) + F.length(said)))


def in_order(rendered: DataFrame) -> DataFrame:
    """Rows of a conversation together and in order, streamed: no conversation is gathered in memory."""
    return rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part", "role", "text")


def _by_conversation(batches: Iterator[pd.DataFrame], start, add, end) -> Iterator[pd.DataFrame]:
    current, state = None, None
    for batch in batches:
        done = []
        for row in batch.itertuples(index=False):
            conv = None if row.conv_id is None else int(row.conv_id)
            if state is None or conv != current:
                if state is not None:
                    done.append(end(current, state))
                current, state = conv, start()
            add(state, row)
        if done:
            yield pd.DataFrame(done)
    if state is not None:
        yield pd.DataFrame([end(current, state)])


def format_conversations(turns: DataFrame) -> DataFrame:
    """A row for each conversation: formatted text and the loss spans in it."""

    def add(state, row):
        if pd.notna(row.loss_start):
            state["loss"].append({"start": state["at"] + int(row.loss_start), "end": state["at"] + int(row.loss_end)})
        state["segments"].append(row.segment)
        state["at"] += len(row.segment)

    def run(batches):
        for out in _by_conversation(batches, lambda: {"segments": [], "loss": [], "at": 0}, add, lambda c, s: {"conv_id": c, "formatted": "".join(s["segments"]), "loss": s["loss"]}):
            yield out.reindex(columns=["conv_id", "formatted", "loss"])

    kept = in_order(render_turns(turns.filter("role IS NOT NULL"))).select(F.col("conv_id").cast("string"), "segment", "loss_start", "loss_end")
    return kept.mapInPandas(run, "conv_id long, formatted string, loss array<struct<start:long,end:long>>")


DIGEST = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def digest_formatted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Read segments back and digest each conversation as its rows stream by."""

    def start():
        return {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0}

    def add(s, row):
        s["formatted"] += len(row.segment)
        for role, text in parse(row.segment):
            s["n"] += 1
            s["turns"].update(f"{role}\n{text}\n".encode())
        if pd.notna(row.loss_start):
            text = unescape(row.segment[int(row.loss_start) : int(row.loss_end)])
            s["chars"] += len(text)
            s["loss"].update(text.encode())

    def end(conv, s):
        return dict(zip(DIGEST, (conv, s["n"], s["turns"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["formatted"])))

    for out in _by_conversation(batches, start, add, end):
        yield out.reindex(columns=DIGEST)


def digest_conversations(turns: DataFrame) -> DataFrame:
    kept = in_order(render_turns(turns.filter("role IS NOT NULL"))).select(F.col("conv_id").cast("string"), "segment", "loss_start", "loss_end")
    return kept.mapInPandas(digest_formatted, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


SAID = "</s>[INST] ok [/INST]"


def op8_chat(spark, sf_dir: str) -> DataFrame:
    from undula.llm.common import read

    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SAID).alias("text"))
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # the same turns in three layouts, so that the fingerprint has something to tell apart; a role with a name of its own stays a plain turn
    said = F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    listed = F.when(role.isin("user", "assistant", "system"), F.pmod(F.xxhash64("conv_id"), F.lit(3))).otherwise(0)
    payload = (
        F.when(listed == 1, F.to_json(F.struct(F.array(F.struct(role.alias("role"), text.alias("content"))).alias("messages"))))
        .when(listed == 2, F.to_json(F.struct(F.col("conv_id").alias("id"), F.array(F.struct(said.alias("from"), text.alias("value"))).alias("conversations"))))
        .otherwise(F.to_json(F.struct(role.alias("role"), text.alias("text"))))
    )
    return digest_conversations(canonical_turns(rows.unionByName(extra).withColumn("payload", payload), order_col="turn"))


ORACLE = r"""
WITH rows_ AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
made AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '<', '<\'), '[', '[\') AS said,
    CASE role WHEN 'user' THEN '[INST] ' WHEN 'assistant' THEN '[ASST] ' WHEN 'system' THEN '[SYS] ' ELSE '[ROLE:' || hex(role) || '] ' END AS opening,
    CASE role WHEN 'user' THEN ' [/INST]' WHEN 'assistant' THEN ' [/ASST]</s>' WHEN 'system' THEN ' [/SYS]' ELSE ' [/ROLE]' END AS closing FROM rows_)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(opening) + length(said) + length(closing)) AS BIGINT) AS formatted_chars
FROM made GROUP BY conv_id
"""
