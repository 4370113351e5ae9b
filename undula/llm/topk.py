"""Exact top-k inner products by distributed histogram selection.

Every query is scored against every candidate, in blocks.  Scores are whole
numbers; the k-th largest score of each query is located digit by digit: each
round builds the global histogram of the next digit among scores that share the
digits found so far, and fixes one digit more.  Then scores above the k-th are
kept, and ties at it are broken by the smaller id.  Scores are computed anew in
each round and never stored.

A task adds up the bins of a query block over all its blocks of candidates, and
sends only bins that its own scores cannot rule out: if k of them reach a bin,
lower bins cannot hold the k-th largest.  So a lane sends at most k bins a query,
however many candidates it has, and at the end at most k ties a query.

Queries are packed in blocks of rows and each block is sent to every lane of
candidates by a join on the lane; nothing passes through the driver but bounds.

Defined results: a vector that is null or holds null or non-finite components
takes no part, nor does a row without id; a row is not its own candidate, nor is
another row with the same id; ids repeated among the queries are answered once
(from the row whose vector sorts first); vectors of unlike length are padded by
zeros; fewer candidates than k give all; scores have to fit a long; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undula.llm.common import checkpoint, partitions

BLOCK = "block string, lane int, n int, dim int, norm double, ids binary, data binary"
DIGIT = 10


def quantized(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component; null if the vector takes no part."""
    x = F.transform(vector, lambda v: F.floor(v.cast("double") * F.lit(float(scale))).cast("double"))
    whole = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf")))
    return F.when(vector.isNotNull() & F.coalesce(whole, F.lit(False)), x)


def _pack(rows: int, lanes: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, len(batch), rows):
                cut = batch.iloc[at : at + rows]
                dim = max(map(len, cut["v"]))
                data = np.zeros((len(cut), dim))
                for k, v in enumerate(cut["v"]):
                    data[k, : len(v)] = v
                norm = float(np.sqrt((data * data).sum(axis=1)).max()) if dim else 0.0
                yield pd.DataFrame([(f"{part}-{made}", (part * 7919 + made) % lanes, len(cut), dim, norm, cut["id"].to_numpy(np.int64).tobytes(), data.tobytes())], columns=["block", "lane", "n", "dim", "norm", "ids", "data"])
                made += 1

    return pack


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whole inner products; exact, as floats where they fit and otherwise as integers."""
    n = min(q.shape[1], c.shape[1])
    q, c = q[:, :n], c[:, :n]
    if np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(n, 1) < 2.0**53:
        return (q @ c.T).astype(np.int64)
    return q.astype(np.int64) @ c.astype(np.int64).T


def _pairs(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, candidate ids, scores); -1 << 62 where the candidate is the query itself."""
    qi, ci = np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.ids, np.int64)
    s = _scores(np.frombuffer(row.q_data).reshape(row.q_n, row.q_dim), np.frombuffer(row.data).reshape(row.n, row.dim))
    s[qi[:, None] == ci[None, :]] = -(1 << 62)
    return qi, ci, s


class _Held(OrderedDict):
    """What a task has gathered for the query blocks it met last; the order of rows decides only how often one is given out."""

    def __init__(self, start, most: int = 8):
        super().__init__()
        self.start, self.most, self.out = start, most, []

    def of(self, row):
        if row.q_block not in self:
            self[row.q_block] = self.start(row)
            if len(self) > self.most:
                self.out.append(self.popitem(last=False)[1])
        self.move_to_end(row.q_block)
        return self[row.q_block]

    def done(self, all_: bool = False):
        out = self.out + (list(self.values()) if all_ else [])
        self.out = []
        return out


def _histogram(k: int, shift: int, offset: int):
    """Counts of the digit at ``shift`` among scores whose higher digits are the query's prefix."""

    def given(state) -> pd.DataFrame:
        ids, counts = state
        reach = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
        r, digit = np.nonzero((counts > 0) & (reach - counts < k))
        return pd.DataFrame({"query_id": ids[r], "digit": digit.astype(np.int32), "n": counts[r, digit].astype(np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = _Held(lambda row: (np.frombuffer(row.q_ids, np.int64), np.zeros((row.q_n, 1 << DIGIT), np.int64)))
        for batch in batches:
            for row in batch.itertuples(index=False):
                _, counts = held.of(row)
                _, _, s = _pairs(row)
                u = s + offset
                prefix = np.frombuffer(row.q_prefix, np.int64)
                top = u >> shift
                r, c = np.nonzero((top >> DIGIT == prefix[:, None]) & (u >= 0))
                cell = r * (1 << DIGIT) + (top[r, c] & ((1 << DIGIT) - 1))
                counts += np.bincount(cell, minlength=counts.size).reshape(counts.shape)
                yield from map(given, held.done())
        yield from map(given, held.done(True))

    return run


def _select(k: int, offset: int):
    """Scores above the query's k-th, and the smallest ids at it; at most k of each for a query block of a task."""

    def fewest(state) -> None:
        """Keep the k smallest ids of each query among its ties."""
        r, c = (np.concatenate(x) for x in state["ties"]) if state["ties"][0] else (np.zeros(0, np.int64),) * 2
        order = np.lexsort((c, r))
        r, c = r[order], c[order]
        first = np.arange(len(r)) - np.searchsorted(r, r) < k
        state["ties"], state["n"] = ([r[first]], [c[first]]), int(first.sum())

    def given(state) -> pd.DataFrame:
        fewest(state)
        (r,), (c,) = state["ties"]
        return pd.DataFrame({"query_id": state["ids"][r], "vec_id": c, "score": state["kth"][r]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = _Held(lambda row: {"ids": np.frombuffer(row.q_ids, np.int64), "kth": np.frombuffer(row.q_prefix, np.int64) - offset, "ties": ([], []), "n": 0})
        for batch in batches:
            for row in batch.itertuples(index=False):
                state = held.of(row)
                qi, ci, s = _pairs(row)
                kth = state["kth"][:, None]
                r, c = np.nonzero(s > kth)
                yield pd.DataFrame({"query_id": qi[r], "vec_id": ci[c], "score": s[r, c]})
                r, c = np.nonzero((s == kth) & (s > -(1 << 61)))
                state["ties"][0].append(r)
                state["ties"][1].append(ci[c])
                state["n"] += len(r)
                if state["n"] > 4 * k * len(qi) + 10_000:
                    fewest(state)
                yield from map(given, held.done())
        yield from map(given, held.done(True))

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int, *, rows: int = 1024) -> DataFrame:
    """queries, candidates: (id long, v array<double> of whole numbers). -> query_id, rank, vec_id, score."""
    spark = queries.sparkSession
    lanes = max(partitions(spark), 1)
    usable = "id IS NOT NULL AND v IS NOT NULL"
    first = queries.filter(usable).groupBy("id").agg(F.min("v").alias("v"))
    blocks = checkpoint(candidates.filter(usable).select("id", "v").mapInPandas(_pack(rows, lanes), BLOCK).repartition(lanes, "lane"))
    asked = checkpoint(first.mapInPandas(_pack(rows, lanes), BLOCK))
    bound = blocks.agg(F.max("norm")).first()[0], asked.agg(F.max("norm")).first()[0]
    if None in bound:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    offset = int(np.ceil(bound[0] * bound[1])) + 1
    digits = max(1, -(-(2 * offset + 1).bit_length() // DIGIT))

    def pairs(state: DataFrame | None) -> DataFrame:
        """Blocks of candidates with blocks of queries; the prefixes found so far are packed in the order of each query block's ids (at most ``rows``)."""
        if state is None:
            q = asked.withColumn("prefix", F.expr("unhex(repeat('00', 8 * n))"))
        else:

            def pack(found: pd.DataFrame) -> pd.DataFrame:
                known = dict(zip(found["query_id"], found["prefix"]))
                ids = np.frombuffer(found["ids"].iloc[0], np.int64)
                return pd.DataFrame({"block": [found["block"].iloc[0]], "prefix": [np.array([known.get(i, 0) for i in ids], np.int64).tobytes()]})

            held = members.join(state, "query_id").join(asked.select("block", "ids"), "block")
            q = asked.join(held.groupBy("block").applyInPandas(pack, "block string, prefix binary"), "block")
        lane = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane")
        # query blocks lead, so that the candidates of a lane come by for one query block after the other
        return q.select(lane, *(F.col(c).alias(f"q_{c}") for c in ("block", "n", "dim", "ids", "data", "prefix"))).hint("merge").join(blocks.select("lane", "n", "dim", "ids", "data"), "lane")

    members = checkpoint(asked.select("block", "ids").mapInPandas(_members, "block string, query_id long"))
    state = None
    for round_ in range(digits):
        shift = DIGIT * (digits - 1 - round_)
        counts = pairs(state).mapInPandas(_histogram(k, shift, offset), "query_id long, digit int, n long").groupBy("query_id", "digit").agg(F.sum("n").alias("n"))
        down = W.partitionBy("query_id").orderBy(F.col("digit").desc())
        need = F.lit(k) if state is None else F.col("need")
        found = counts.withColumn("upto", F.sum("n").over(down))
        found = found if state is None else found.join(state, "query_id")
        # The digit in which the running count from the top reaches what is still needed; the lowest digit if it never does.
        reached = F.col("upto") >= need
        step = found.withColumn("_need", need.cast("long")).groupBy("query_id").agg(
            F.max(F.when(reached, F.col("digit"))).alias("digit"), F.min("digit").alias("low"),
            F.max_by(F.col("_need") - (F.col("upto") - F.col("n")), F.when(reached, F.col("digit"))).alias("need"),
            F.max("_need").alias("was"), *([] if state is None else [F.max("prefix").alias("prefix")]),
        )
        before = F.lit(0).cast("long") if state is None else F.col("prefix")
        state = checkpoint(
            step.select("query_id", (before * (1 << DIGIT) + F.coalesce("digit", "low")).alias("prefix"), F.coalesce("need", "was").cast("long").alias("need"))
        )
    chosen = pairs(state).mapInPandas(_select(k, offset), "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return chosen.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for block, ids in zip(batch["block"], batch["ids"]):
            yield pd.DataFrame({"block": block, "query_id": np.frombuffer(ids, np.int64)})


def op9_topk(spark, sf_dir: str) -> DataFrame:
    from undula.llm.common import read

    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), quantized(F.col("embedding"), 64).alias("v"))
    return top_k(vectors.filter(F.col("id") % 20 == 0), vectors, 20)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20
"""
