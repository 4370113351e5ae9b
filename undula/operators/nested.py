"""Rewriting inside JSON documents, at any depth."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.operators.batches import by_slices
from undula.operators.sized import MOST_ROWS

#: Stand for an escaped backslash and an escaped quote; JSON text holds no raw control characters.
_SLASH, _QUOTE = "\u0001", "\u0002"


def canonical_json(text: Column) -> Column:
    """The document without white space, its keys in order, by way of VARIANT; null where it is no JSON."""
    return F.to_json(F.try_parse_json(text))


def _flat(json: Column) -> Column:
    """JSON text whose quotes are all ends of strings."""
    return F.replace(F.replace(json, F.lit("\\\\"), F.lit(_SLASH)), F.lit('\\"'), F.lit(_QUOTE))


def _restored(flat: Column) -> Column:
    return F.replace(F.replace(flat, F.lit(_QUOTE), F.lit('\\"')), F.lit(_SLASH), F.lit("\\\\"))


def _literal(text: Column) -> Column:
    """A string as it stands in canonical JSON text, with its quotes."""
    whole = F.to_json(F.try_parse_json(F.to_json(F.array(text))))
    return F.substr(whole, F.lit(2), F.length(whole) - 2)


def _by_lookup(docs: DataFrame, column: str, known: dict[str, str], key: str, out: str) -> DataFrame:
    """Each document in its own row, its members looked up in a broadcast table: no shuffle."""
    # In JSON text a quote inside a string has a backslash before it, so one after a brace or comma, with key and colon, opens a key.
    member = re.compile(f'(?<=[{{,]"{re.escape(key)}":)"(?:[^"\\\\]|\\\\.)*"')
    held = docs.sparkSession.sparkContext.broadcast(known)

    def rewritten(texts) -> list[str | None]:
        shown = held.value
        swap = lambda m: shown.get(m[0], m[0])
        return [None if t is None else member.sub(swap, t) for t in texts]

    return docs.withColumn(out, F.coalesce(by_slices(rewritten, "string", pa.string())(canonical_json(F.col(column))), F.col(column)))


def strip_paths(docs: DataFrame, column: str, mapping: DataFrame, *, key: str = "path", out: str = "stripped", most: int = MOST_ROWS) -> DataFrame:
    """Add ``out``: the document of ``column`` with every text under ``key``, at any depth, that ``mapping`` (path, shown) holds, replaced by ``shown``.

    Other texts, other keys and the same words inside texts stay.  Documents come out in canonical form; what is no JSON stays
    as it is, null stays null, and texts under ``key`` that are no strings or not in the mapping stay.  Of several mappings of
    one path the smallest counts; null paths and null results take no part.

    A mapping of at most ``most`` rows is broadcast as a table to look members up in.  With a larger one documents go by the digest
    of their text, so repeated ones are rewritten once and none has to have a key of its own; each member under ``key`` becomes a
    row, and only these rows meet the mapping.
    """
    known = mapping.filter("path IS NOT NULL AND shown IS NOT NULL").groupBy("path").agg(F.min("shown").alias("shown")).select(_literal(F.col("path")).alias("_old"), _literal(F.col("shown")).alias("_new"))
    found = known.limit(most + 1).collect()  # narrow rows, as many as a broadcast join may hold
    if len(found) <= most:
        return _by_lookup(docs, column, {r["_old"]: r["_new"] for r in found}, key, out)
    text = canonical_json(F.col(column))
    # A quote after a brace or comma opens a string, as one that closes a string is followed by neither the key nor a colon.
    member = f'(?<=[{{,])"{key}":(?=")'
    flat = docs.withColumn("_flat", _flat(text)).withColumn("_hit", F.coalesce(F.regexp_like("_flat", F.lit(member)), F.lit(False)))
    flat = flat.withColumn("_digest", F.when(F.col("_hit"), F.sha2("_flat", 256)))
    pieces = flat.filter("_hit").select("_digest", "_flat").dropDuplicates(["_digest"]).select("_digest", F.posexplode(F.split("_flat", member)).alias("_at", "_piece"))
    pieces = pieces.withColumn("_old", F.when(F.col("_at") > 0, F.regexp_extract("_piece", '^"[^"]*"', 0)))
    put = pieces.join(known.select(_flat(F.col("_old")).alias("_old"), _flat(F.col("_new")).alias("_new")), "_old", "left")
    name = F.lit(f'"{key}":')
    part = F.when(F.col("_at") == 0, F.col("_piece")).otherwise(F.concat(name, F.coalesce("_new", "_old"), F.substr("_piece", F.length("_old") + 1)))
    made = put.groupBy("_digest").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", part.alias("p")))), lambda s: s["p"]), "").alias("_made"))
    joined = flat.join(made, "_digest", "left")
    return joined.withColumn(out, F.coalesce(_restored(F.coalesce("_made", "_flat")), F.col(column))).drop("_flat", "_hit", "_digest", "_made")
