"""Benchmark decontamination by q-gram lemma filtering.

Texts are compared as lower-case words, one space between them.  Each benchmark
item is cut into windows of ``window`` characters, half a window apart, so that
every verbatim passage of ``PASSAGE`` characters (some 13 words), wherever it
starts, holds a whole window.  An occurrence of
a window of m characters with at most e edits shares at least
m - q + 1 - q * e of its q-grams with the document, all on diagonals at most e
apart.  So shared q-grams are counted in overlapping bands of diagonals, each as
wide as two such ranges, so that every range lies in one band; regions that
reach the bound are verified by an alignment within the band.

Equal windows of several items are one window.  A q-gram of very many windows, as
of a prompt that all items share, is left out where a window's other q-grams are
enough: of r others at least r - q * e are shared, so nothing is lost.

The benchmark is small next to the documents: its index is sent to all tasks in
pieces of a checked size, several pieces in one pass over the documents, and texts
are never shuffled.  A benchmark of more pieces takes more passes; each is written
and its pieces are taken back before the next, so what is broadcast is bounded.

Defined results: a null text or item is empty and matches nothing; an item of
fewer than ``LEAST`` characters of normalized text, which common speech may hold,
matches only a document that says nothing else; repeated rows and items are
separate rows; a document with many matches keeps the best of each item; an empty
table or an empty benchmark gives no matches; other columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm.common import checkpoint

Q = 12
#: Least length of a passage that is always found, in characters of normalized text.
PASSAGE = 75
#: A window and half a window less one character fit into such a passage.
WINDOW = 2 * (PASSAGE + 1) // 3
EDITS = 0.06
#: Items shorter than this, in characters of normalized text, must be the whole document.
LEAST = 32
#: q-grams of more windows than this are left out where a window has enough others.
OFTEN = 32
#: Characters of benchmark text indexed at once, and how many such pieces are searched for in one pass.
PIECE = 4_000_000
PIECES = 8
MATCHES = "doc_id string, item_id long, start int, end int, edits int"

_OTHER = re.compile(r"[\W_]+")


def normalized(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def _hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q characters from each place, by doubling."""
    base = np.uint64(0x9E3779B97F4A7C15)
    done, n = None, 0
    part, size, power = codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), 1, base
    with np.errstate(over="ignore"):
        while True:
            if q & size:
                if done is None:
                    done, n = part, size
                else:  # the part follows what is done
                    m = len(codes) - n - size + 1
                    if m <= 0:
                        return np.zeros(0, np.uint64)
                    done = done[:m] * power + part[n : n + m]
                    n += size
            if size * 2 > q:
                break
            m = len(part) - size
            if m <= 0:
                return np.zeros(0, np.uint64)
            part = part[:m] * power + part[size:]
            power, size = power * power, size * 2
        done = done ^ (done >> np.uint64(29))
        return done * np.uint64(0xBF58476D1CE4E5B9)


def banded_distance(pattern: str, region: str, budget: int) -> tuple[int, int, int] | None:
    """Least edits of ``pattern`` against any part of ``region``, with that part's bounds; None beyond ``budget``.

    Row by row over the pattern; only the diagonals that ``region`` leaves are computed.
    """
    at = region.find(pattern)
    if at >= 0:
        return 0, at, at + len(pattern)
    m, n = len(pattern), len(region)
    p, r = np.frombuffer(pattern.encode("utf-32-le"), np.uint32), np.frombuffer(region.encode("utf-32-le"), np.uint32)
    columns = np.arange(n + 1)
    row, begin = np.zeros(n + 1, np.int64), columns.copy()
    for i in range(m):
        new = np.empty(n + 1, np.int64)
        first = np.empty(n + 1, np.int64)
        diagonal = row[:-1] + (r != p[i])
        down = row[1:] + 1
        new[0], first[0] = row[0] + 1, begin[0]
        new[1:] = np.minimum(diagonal, down)
        first[1:] = np.where(diagonal <= down, begin[:-1], begin[1:])
        lifted = new - columns
        best = np.minimum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == best, columns, 0))
        row, begin = best + columns, first[source]
        if row.min() > budget:
            return None
    end = int(row.argmin())
    return (int(row[end]), int(begin[end]), end) if row[end] <= budget else None


class Index:
    """q-grams of the windows of some benchmark items."""

    def __init__(self, items: list[tuple[int, str]], *, q: int = Q, window: int = WINDOW, edits: float = EDITS):
        self.q = q
        self.whole: dict[str, list[int]] = {}  # short texts and their items
        held: dict[str, set[int]] = {}  # windows and their items
        for item, text in items:
            text = normalized(text)
            if 0 < len(text) < max(LEAST, q):
                self.whole.setdefault(text, []).append(item)
            elif text:
                for a in sorted({*range(0, max(1, len(text) - window + 1), window // 2), max(0, len(text) - window)}):
                    held.setdefault(text[a : a + window], set()).add(item)
        self.windows = [(part, min(int(edits * len(part)), (len(part) - q) // q)) for part in held]  # text, edits
        self.items = [sorted(x) for x in held.values()]
        self.edits = np.array([e for _, e in self.windows] or [0])
        self.width = 2 * int(self.edits.max()) + 1
        each = [_hashes(np.frombuffer(part.encode("utf-32-le"), np.uint32), q) for part, _ in self.windows]
        h = np.concatenate(each) if each else np.zeros(0, np.uint64)
        rows = np.concatenate([np.stack([np.full(len(x), k), np.arange(len(x))], axis=1) for k, x in enumerate(each)]) if each else np.zeros((0, 2), np.int64)
        _, at, many = np.unique(h, return_inverse=True, return_counts=True)
        rare = many[at] <= OFTEN
        n, rares = (np.bincount(rows[pick, 0], minlength=len(self.windows)) for pick in (slice(None), rare))
        enough = rares > q * self.edits[: len(n)]
        self.least = np.maximum(1, np.where(enough, rares, n) - q * self.edits[: len(n)])
        keep = rare | ~enough[rows[:, 0]]
        h, rows = h[keep], rows[keep]
        order = np.argsort(h, kind="stable")
        self.rows = rows[order]
        self.keys, self.first = np.unique(h[order], return_index=True)
        self.last = np.append(self.first[1:], len(h))
        self.bits = max(16, int(len(self.keys) * 16).bit_length())
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self.keys >> np.uint64(64 - self.bits)] = True

    def matches(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """For each normalized text its (item, start, end, edits), the best of each item."""
        found: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]

        def keep(doc: int, items: list[int], start: int, end: int, edits: int) -> None:
            mine = found[doc]
            for item in items:
                best = mine.get(item)
                if best is None or (edits, start, end) < (best[2], best[0], best[1]):
                    mine[item] = (start, end, edits)

        for k, t in enumerate(texts):
            if t in self.whole:
                keep(k, self.whole[t], 0, len(t), 0)
        joined = "\x00".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        h = _hashes(codes, self.q)
        place = np.flatnonzero(self.seen[h >> np.uint64(64 - self.bits)])
        if len(place) and len(self.keys):
            key = np.minimum(np.searchsorted(self.keys, h[place]), len(self.keys) - 1)
            real = self.keys[key] == h[place]
            place, key = place[real], key[real]
            many = self.last[key] - self.first[key]
            which = np.repeat(np.arange(len(key)), many)
            row = self.rows[self.first[key][which] + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)]
            window, offset, pos = row[:, 0], row[:, 1], place[which]
            diagonal = pos - offset + WINDOW * 4  # so that none is negative
            band = diagonal // self.width
            bands = int(len(codes) + WINDOW * 8) // self.width + 2
            both = np.concatenate([window * bands + band, window * bands + band - 1])
            # each q-gram of a window counts once in a band
            each = np.unique(np.stack([both, np.concatenate([offset, offset])], axis=1), axis=0)[:, 0]
            cell, shared = np.unique(each, return_counts=True)
            cell = cell[shared >= self.least[cell // bands]]
            starts = np.cumsum([0] + [len(t) + 1 for t in texts])
            for c in cell.tolist():
                w, b = divmod(c, bands)
                part, e = self.windows[w]
                lo = b * self.width - WINDOW * 4 - e
                hi = lo + 2 * self.width + len(part) + 2 * e
                doc = int(np.searchsorted(starts, min(max(lo + (hi - lo) // 2, 0), len(codes) - 1), side="right")) - 1
                for d in (doc - 1, doc, doc + 1):  # a band may touch the texts beside
                    if 0 <= d < len(texts):
                        a = max(lo - int(starts[d]), 0)
                        region = texts[d][a : max(hi - int(starts[d]), 0)]
                        if len(region) + e >= len(part) and (m := banded_distance(part, region, e)):
                            keep(d, self.items[w], a + m[1], a + m[2], m[0])
        return [[(item, *v) for item, v in sorted(f.items())] for f in found]


def _pieces(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[Index]:
    """Indexes of the items, each of at most about PIECE characters."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).filter("item IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // PIECE)
    for k in range(n):
        mine = items if n == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield Index([(r.item, r.text) for r in mine.orderBy("item", "text").toLocalIterator()])


def _batches(texts: list[str], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    at, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= size or k == len(texts) - 1:
            yield at, k + 1
            at, held = k + 1, 0


def _passes(docs: DataFrame, benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[list, bool]]:
    """(broadcast indexes of a pass, whether it is the last)."""
    held: list = []
    for index in _pieces(benchmark, item_col, text_col):
        if len(held) == PIECES:
            yield held, False
            held = []
        held.append(docs.sparkSession.sparkContext.broadcast(index))
    yield held, True


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start, end, edits) for each document and item that matches; offsets are in the normalized text."""
    out = docs.sparkSession.createDataFrame([], MATCHES)
    for shared, last in _passes(docs, benchmark, item_col, item_text_col):

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                ids, texts = batch["id"].tolist(), [normalized(t) for t in batch["text"]]
                for a, b in _batches(texts):
                    for index in shared:
                        rows = [(ids[a + k], *m) for k, found in enumerate(index.value.matches(texts[a:b])) for m in found]
                        yield pd.DataFrame(rows, columns=["doc_id", "item_id", "start", "end", "edits"])

        found = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, MATCHES)
        if shared:
            out = out.unionByName(found if last else _written(found, shared))
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _written(df: DataFrame, shared: list) -> DataFrame:
    out = checkpoint(df)
    for index in shared:
        index.destroy()
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage; rows are filtered where they are read."""
    for shared, last in _passes(docs, benchmark, item_col, item_text_col):
        if shared:
            docs = docs.filter(_clean(shared)(F.col(text_col)))
            docs = docs if last else _written(docs, shared)
    return docs


def _clean(shared: list):
    @F.pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        texts = [normalized(t) for t in text]
        out = np.ones(len(texts), bool)
        for a, b in _batches(texts):
            for index in shared:
                out[a:b] &= [not m for m in index.value.matches(texts[a:b])]
        return pd.Series(out)

    return clean


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    from undula.llm.common import read

    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
