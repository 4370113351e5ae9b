"""Language spans of mixed text: script ranges, scores of words, Viterbi with a switching penalty.

The model holds, for each language, the shares of its letters by script and the
counts of letter groups (one to three, with a mark at the ends of words) of all
texts to learn from.  Counts are added up in each task and then by Spark; the
model keeps at most ``groups`` of them, those with the largest share of their
language, so it can be broadcast.

A word is a run of letters.  The script of most of its letters narrows the
candidates to languages that are written in it; its score for a candidate is the
log probability of its letter groups, averaged over their sizes.  The best path of
languages over all words of a text pays ``penalty`` for each switch; ties keep the
language, then prefer the first in code-point order.  All texts of a slice go
forward a word at a time together.

Defined results: a null text, an empty one, and one without a letter have no
spans, nor has any text if nothing was learned; a word in a script that no
language is written in tells nothing and goes with its neighbours; a text in which
no word tells anything is taken as the language with the most letters; texts and words
of any length count whole; rows with null ids are judged, but not learned from; rows that
repeat are judged alike; other columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm.common import read

#: First code points of blocks of one script, by the Unicode standard; "" for blocks of no or of several scripts.
SCRIPT_STARTS = (
    (0x0000, "Latin"), (0x0250, "Latin"), (0x02B0, ""), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, ""),
    (0x08A0, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1400, "Aboriginal"),
    (0x1680, ""), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, ""), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"), (0x1CC0, ""), (0x1D00, "Latin"), (0x1DC0, ""), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""),
    (0x2C60, "Latin"), (0x2C80, ""), (0x2D00, "Georgian"), (0x2D30, ""), (0x2DE0, "Cyrillic"), (0x2E00, ""), (0x2E80, "Han"), (0x2FE0, ""), (0x3005, "Han"), (0x3041, "Kana"), (0x3100, "Bopomofo"), (0x3130, "Hangul"),
    (0x3190, ""), (0x31F0, "Kana"), (0x3200, ""), (0x3400, "Han"), (0x4DC0, ""), (0x4E00, "Han"), (0xA000, ""), (0xA640, "Cyrillic"), (0xA6A0, ""), (0xA720, "Latin"), (0xA800, ""), (0xAC00, "Hangul"), (0xD7B0, ""),
    (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, ""), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, ""), (0x20000, "Han"),
    (0x323B0, ""),
)
_STARTS, _NAMES = [s for s, _ in SCRIPT_STARTS], [n for _, n in SCRIPT_STARTS]
_WORD = re.compile(r"([^\W\d_]+)")
SIZES = (1, 2, 3)
#: Words whose counts or scores a task holds at once, times languages for scores, and letters judged at once, times languages.
HELD_WORDS, HELD_SCORES, AT_ONCE = 300_000, 4_000_000, 24_000_000
COUNTS = "lang string, script string, item long, n long"
SPANS = "array<struct<start: long, end: long, lang: string, letters: long>>"


def script_of(word: str) -> str:
    """The script of most of the letters, of equals the first to occur; empty if none is known."""
    if max(word) < "\u0250":
        return "Latin"
    found = Counter(s for s in (_NAMES[bisect_right(_STARTS, ord(c)) - 1] for c in word if c.isalpha()) if s)
    return max(found, key=found.get, default="")


def letter_groups(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For sizes 1, 2, 3: the groups of letters of words in lower case, as numbers of 21 bits a letter, and the word each is of.

    Groups of two and three see a blank at the ends of the word.
    """
    lower = [w.lower() for w in words]
    letters = np.frombuffer(f" {' '.join(lower)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    of = np.repeat(np.arange(len(lower)), np.fromiter(map(len, lower), np.int64, len(lower)) + 1)  # a word and the blank before it
    inner = letters[1:-1] != 32
    triples = letters[:-2] << 42 | letters[1:-1] << 21 | letters[2:]
    return [(letters[1:-1][inner], of[1:][inner]), (letters[:-1] << 21 | letters[1:], of), (triples[inner], of[1:][inner])]


# -- learning ------------------------------------------------------------------


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of scripts and letter groups by language, of (lang, text)."""
    words: dict[str, Counter] = {}

    def given() -> Iterator[pd.DataFrame]:
        for lang, counts in words.items():
            kept = [w for w in counts if w.isalpha() or any(map(str.isalpha, w))]
            if not kept:
                continue
            n = np.array([counts[w] for w in kept], np.float64)
            scripts = Counter()
            for word in kept:
                scripts[script_of(word)] += counts[word] * len(word)
            yield pd.DataFrame({"lang": lang, "script": list(scripts), "item": pd.array([pd.NA] * len(scripts), "Int64"), "n": list(scripts.values())})
            for groups, of in letter_groups(kept):
                items, at = np.unique(groups, return_inverse=True)
                yield pd.DataFrame({"lang": lang, "script": None, "item": items, "n": np.bincount(at, weights=n[of]).astype(np.int64)})
        words.clear()

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            words.setdefault(lang, Counter()).update(_WORD.findall(text))
            if sum(map(len, words.values())) > HELD_WORDS:
                yield from given()
    yield from given()


@dataclass
class Model:
    """Row k of ``logs`` (group, language) is that of group ``groups[k]``, which rise; below them stand the rows of unknown groups of each size."""

    langs: list[str]
    groups: np.ndarray
    logs: np.ndarray
    scripts: dict[str, np.ndarray]
    common: int = 0
    cache: dict[str, int] = field(default_factory=dict)
    held: np.ndarray | None = None

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probabilities of words, less the best of each; zero for all if no language is written in the script."""
        found = np.zeros((len(words), len(self.langs)))
        for k, (groups, of) in enumerate(letter_groups(words)):
            at = np.searchsorted(self.groups, groups)
            known = np.append(self.groups, -1)[at] == groups
            logs = self.logs[np.where(known, at, len(self.groups) + k)]
            found += np.add.reduceat(logs, np.searchsorted(of, np.arange(len(words))), axis=0) / len(SIZES)
        none = np.zeros(len(self.langs), bool)
        found[~np.array([self.scripts.get(script_of(w), none) for w in words])] = -np.inf
        best = found.max(1, keepdims=True)
        # Languages out of question count as impossible, but by a finite number, so that a path always exists.
        return np.where(np.isinf(best), 0.0, np.maximum(found - np.where(np.isinf(best), 0.0, best), -1e4))

    def ids(self, words: list[str]) -> np.ndarray:
        """Places of words in ``held``; -1 for those without a letter."""
        cache = self.cache
        new = [w for w in dict.fromkeys(words) if w not in cache]
        if self.held is None:
            self.held = np.zeros((0, len(self.langs)))
        kept = [w for w in new if w.isalpha() or any(map(str.isalpha, w))]
        cache.update(dict.fromkeys(new, -1))
        cache.update(zip(kept, range(len(self.held), len(self.held) + len(kept))))
        self.held = np.concatenate([self.held, *(self.word_scores(kept[at : at + 20_000]) for at in range(0, len(kept), 20_000))])
        return np.fromiter(map(cache.__getitem__, words), np.int64, len(words))

    def forget(self) -> None:
        if len(self.cache) * len(self.langs) > HELD_SCORES:
            self.cache, self.held = {}, None


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang", groups: int = 200_000, languages: int = 200, share: float = 0.005, smoothing: float = 0.5) -> Model:
    """A model of all rows of ``docs`` that have a text and a language.

    It keeps the ``languages`` with the most letters and ``groups`` letter groups.  A language is written in the scripts that have at least ``share`` of its letters.
    """
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    # Counts of tasks are as many as groups, not as texts; the cache saves a second pass over the texts.
    counts = rows.mapInPandas(_counted, COUNTS).groupBy("lang", "script", "item").agg(F.sum("n").alias("n")).cache()
    try:
        scripts = counts.filter("item IS NULL")
        totals = scripts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "lang").limit(languages).collect()
        letters = {r["lang"]: r["n"] for r in totals}
        langs = sorted(letters)
        known = F.col("lang").isin(langs)
        written: dict[str, set[str]] = {}
        for r in scripts.filter(known & (F.col("script") != "")).toLocalIterator():
            if r["n"] >= share * letters[r["lang"]]:
                written.setdefault(r["script"], set()).add(r["lang"])
        grouped = counts.filter(F.col("item").isNotNull() & known)
        k = F.when(F.col("item") < 1 << 21, 1).when(F.col("item") < 1 << 42, 2).otherwise(3)
        sums = {(r["lang"], r["k"]): (r["all"], r["kinds"]) for r in grouped.groupBy("lang", k.alias("k")).agg(F.sum("n").alias("all"), F.count("*").alias("kinds")).collect()}
        total = F.coalesce(*(F.when(F.col("lang") == x, F.lit(n)) for x, n in letters.items())) if letters else F.lit(1)
        kept = grouped.select("lang", "item", "n", (F.col("n") / total).alias("part")).orderBy(F.col("part").desc(), "item", "lang").limit(groups).toPandas()
    finally:
        counts.unpersist()
    items = np.unique(kept["item"].to_numpy(np.int64))
    seen = np.zeros((len(items) + len(SIZES), len(langs)))
    seen[np.searchsorted(items, kept["item"].to_numpy(np.int64)), np.searchsorted(np.array(langs, object), kept["lang"].to_numpy(object))] = kept["n"]
    sizes = np.concatenate([1 + (items >= 1 << 21) + (items >= 1 << 42), SIZES])
    logs = np.log(seen + smoothing)
    for k in SIZES:
        most = max((sums.get((x, k), (0, 0))[1] for x in langs), default=0)
        for at, x in enumerate(langs):
            logs[sizes == k, at] -= math.log(sums.get((x, k), (0, 0))[0] + smoothing * (most + 1))
    common = max(range(len(langs)), key=lambda at: letters[langs[at]], default=0)
    return Model(langs, items, logs, {s: np.array([x in v for x in langs]) for s, v in written.items()}, common)


# -- judging -------------------------------------------------------------------


def best_paths(scores: np.ndarray, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """The language of each word of several texts; words of text i are ``ids[starts[i] : starts[i] + sizes[i]]``, sizes never rise and are not zero."""
    k = scores.shape[1]
    own = np.arange(k, dtype=np.int16)
    back = np.zeros((len(ids), k), np.int16)
    label = np.zeros(len(ids), np.int16)
    running = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")  # texts that have a word t
    s = scores[ids[starts]]
    ends = s.copy()
    for t in range(1, int(sizes[0])):
        m = running[t]
        s = s[:m]
        at = starts[:m] + t
        best = s.max(1, keepdims=True)
        stay = s >= best - penalty
        back[at] = np.where(stay, own, s.argmax(1)[:, None])
        s = np.where(stay, s - best, -penalty) + scores[ids[at]]
        ends[:m] = s
    now = ends.argmax(1)
    label[starts + sizes - 1] = now
    for t in range(int(sizes[0]) - 1, 0, -1):
        m = running[t]
        now[:m] = back[starts[:m] + t, now[:m]]
        label[starts[:m] + t - 1] = now[:m]
    return label


def _spans_of(model: Model, texts: list[str], penalty: float) -> list[list[dict]]:
    places, ids = [], []
    cut = [_WORD.split(text) for text in texts]
    all_ids = model.ids([w for parts in cut for w in parts[1::2]])
    at = 0
    for parts in cut:
        found = all_ids[at : at + len(parts) // 2]
        at += len(found)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        told = found >= 0
        ids.append(found[told])
        places.append((ends[0:-1:2][told], ends[1::2][told]))
    sizes = np.array([len(x) for x in ids])
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    out: list[list[dict]] = [[] for _ in texts]
    if not len(order):
        return out
    ids_ = np.concatenate([ids[i] for i in order])
    starts = np.cumsum(sizes[order]) - sizes[order]
    label = best_paths(model.held, ids_, starts, sizes[order], penalty)
    for i, a in zip(order, starts):
        got = label[a : a + sizes[i]]
        if not model.held[ids[i]].any():
            got = np.full(sizes[i], model.common)
        first = np.flatnonzero(np.concatenate([[True], got[1:] != got[:-1]]))
        last = np.concatenate([first[1:], [len(got)]]) - 1
        start, end = places[i]
        letters = np.add.reduceat(end - start, first)
        out[i] = [{"start": a, "end": b, "lang": model.langs[x], "letters": n} for a, b, x, n in zip(start[first].tolist(), end[last].tolist(), got[first], letters.tolist())]
    return out


def _judged(told, penalty: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: Model = told.value
        most = AT_ONCE // max(len(model.langs), 1)
        for batch in batches:
            texts, at = [t or "" for t in batch["text"]], 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= most):
                    size += len(texts[to])
                    to += 1
                cut = batch.iloc[at:to].drop(columns="text")
                cut["spans"] = _spans_of(model, texts[at:to], penalty) if model.langs else [[] for _ in range(at, to)]
                model.forget()
                yield cut
                at = to

    return run


def language_spans(docs: DataFrame, model: Model, *, id: str = "doc_id", text: str = "text", penalty: float = 8.0) -> DataFrame:  # noqa: A002
    """(id, spans) of each row: spans are (start, end, lang, letters), places in code points, end exclusive; between spans there are no letters."""
    told = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(id), F.col(text).alias("text")).mapInPandas(_judged(told, penalty), f"`{id}` {dict(docs.dtypes)[id]}, spans {SPANS}")


def main_language(spans: Column) -> Column:
    """(lang_pred, score): the language with the most letters, of equals the first in code-point order, and its share of them; ``und`` and 0 without spans."""
    names = F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["lang"])))
    letters = lambda which: F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + F.when(which(s), s["letters"]).otherwise(0))
    sums = F.transform(names, lambda x: F.struct(letters(lambda s: s["lang"] == x).alias("n"), x.alias("lang")))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit("und").alias("lang"))
    best = F.aggregate(sums, none, lambda a, b: F.when(b["n"] > a["n"], b).otherwise(a))
    return F.transform(F.array(best), lambda b: F.struct(b["lang"].alias("lang_pred"), F.coalesce(F.try_divide(b["n"].cast("double"), letters(lambda _: F.lit(True))), F.lit(0.0)).alias("score")))[0]


# -- query -----------------------------------------------------------------------


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main language of each document by its language spans."""
    docs = read(spark, sf_dir, "documents")
    model = learn(docs.filter(fold(F.col("doc_id")) != 1))
    found = language_spans(docs, model).withColumn("_main", main_language(F.col("spans")))
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "_main.lang_pred", "_main.score", "spans")
