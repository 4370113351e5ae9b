"""Secret scans over a ledger of blobs.

Every version of every path is addressed by the SHA-256 of its content.  The
ledger records which (blob, rule, rule version) triples were scanned and what
was found, so a run scans only the triples it has not seen, each blob once
however many paths hold it, and joins the findings back to all paths.

Only digests are shuffled to find the distinct blobs.  Where what is to be scanned
or what is not is a short list, that list goes to the texts; else the texts of
distinct blobs are shuffled once.  Scanning is a pure function of the text.

Defined results: a null text is the empty text; offsets are code points, end
exclusive; spans of one kind never overlap; repeated rows are separate rows of
the result with the same findings; an empty table gives an empty result; other
columns of the input are left aside.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm.common import checkpoint

#: Up to so many copies (a digest and an id each) their list is broadcast; beyond, texts are joined by shuffle.
BROADCAST_COPIES = 500_000

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PRIVATE = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")


def _assign(text: str) -> list[tuple[int, int]]:
    lowered = text.lower()
    if not any(name in lowered for name in _NAMES):
        return []
    return [m.span() for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]


def _access(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]


def _spans(pattern: re.Pattern):
    return lambda text: [m.span() for m in pattern.finditer(text)]


#: Kind -> (version, function), in the order in which kinds are listed. A changed rule gets a new version.
RULES = {
    "assign": (1, _assign),
    "access": (1, _access),
    "hex": (1, _spans(_HEX)),
    "private": (1, _spans(_PRIVATE)),
    "jwt": (1, _spans(_JWT)),
}
BASE = ("assign", "access", "hex")
LEDGER = "blob string, rule string, version int, found array<int>"  # found: start, end, start, end ...
SLICE = 500  # blobs whose findings are sent at once


def scanner(rules: dict):
    """(blob, content, names of rules to apply) -> a ledger row for each blob and rule."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                cut = batch.iloc[at : at + SLICE]
                rows = []
                for blob, content, names in zip(cut["blob"], cut["content"], cut["rules"]):
                    for name in names:
                        version, find = rules[name]
                        rows.append((blob, name, version, [x for span in find(content) for x in span]))
                yield pd.DataFrame(rows, columns=["blob", "rule", "version", "found"])

    return scan


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, *, rules: dict = RULES, content_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``versions``: a row for each version of each path, told apart by ``id_col``.

    Returns (addressed, ledger): the ids with their blob, and the ledger with the rows of this run added.
    """
    spark = versions.sparkSession
    content = F.coalesce(F.col(content_col), F.lit(""))
    held = versions.select(F.col(id_col).alias("id"), content.alias("content")).withColumn("blob", F.sha2(F.col("content").cast("binary"), 256))
    addressed = checkpoint(held.select("id", "blob"))

    asked = F.array(*(F.struct(F.lit(k).alias("rule"), F.lit(v).alias("version")) for k, (v, _) in rules.items()))
    todo = addressed.groupBy("blob").agg(F.min("id").alias("id")).select("blob", "id", F.inline(asked))
    if ledger is not None:
        todo = todo.join(ledger.select("blob", "rule", "version"), ["blob", "rule", "version"], "left_anti")
    todo = todo.groupBy("blob", "id").agg(F.array_sort(F.collect_list("rule")).alias("rules"))  # at most one of each rule
    todo = checkpoint(todo.select(F.col("blob").alias("_blob"), F.col("id").alias("_id"), "rules"))
    one = (F.col("blob") == F.col("_blob")) & F.col("id").eqNullSafe(F.col("_id"))
    if ledger is None:  # all rules for all blobs
        copies = checkpoint(addressed.join(todo, one, "left_anti").distinct().select(F.col("blob").alias("_blob"), F.col("id").alias("_id")))
        if copies.count() <= BROADCAST_COPIES:
            work = held.join(F.broadcast(copies), one, "left_anti").withColumn("rules", F.array(*(F.lit(k) for k in sorted(rules))))
        else:
            work = held.join(todo, one)
    else:
        work = held.join(F.broadcast(todo) if todo.count() <= BROADCAST_COPIES else todo, one)
    fresh = checkpoint(work.select("blob", "content", "rules").mapInPandas(scanner(rules), LEDGER)).dropDuplicates(["blob", "rule"])
    return addressed, fresh if ledger is None else ledger.unionByName(fresh)


def findings_by_path(addressed: DataFrame, ledger: DataFrame, *, rules: dict = RULES) -> DataFrame:
    """A row for each id: the spans of all its findings under the current rule versions, by start, then kind as listed."""
    kinds = F.array(*map(F.lit, rules))
    versions = F.create_map(*(F.lit(x) for k, (v, _) in rules.items() for x in (k, v)))
    spans = (
        ledger.filter((F.size("found") > 0) & (F.col("version") == F.element_at(versions, F.col("rule"))))
        .select("blob", "rule", F.explode(F.transform(F.sequence(F.lit(0), F.size("found") - 1, F.lit(2)), lambda k: F.struct(F.get("found", k).alias("start"), F.get("found", k + 1).alias("end")))).alias("f"))
        .groupBy("blob")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("f.start").alias("start"), F.array_position(kinds, F.col("rule")).alias("place"), F.col("f.end").alias("end"), F.col("rule").alias("kind")))).alias("spans"))
    )
    empty = F.from_json(F.lit("[]"), "array<struct<start:int,place:bigint,end:int,kind:string>>")
    return addressed.join(spans, "blob", "left").select("id", "blob", F.coalesce("spans", empty).alias("spans"))


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    from undula.llm.common import read

    found = findings_by_path(*scan_versions(read(spark, sf_dir, "documents")))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [count(kind) for kind in BASE]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
