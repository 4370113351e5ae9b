"""Toxicity by weak supervision.

Voters are lexicon entries and word patterns: a listed insult, or a word or word
beginning that a bounded sample of labelled rows shows to go with toxicity, each
seen at least once, twice or three times in a text; and a voter for texts in which
none of them occurs.  A generative label model (two classes, expectation
maximisation) sees only votes, those of unlabelled rows too: it estimates how often
each voter fires in either class and, from the correlations that the class does not
explain, how much of its evidence repeats that of others.  A linear classifier
(logistic regression) is trained on the posterior labels and scores every text.
Labels choose the candidates and set the scale of the scores; they are no votes.

Candidates are counted by Spark over the sample.  What reaches the driver is
bounded: the chosen entries (``VOTERS``) and, for each of at most ``sample`` labelled
ids and about ``sample`` others, which of them occur.  Scoring is one pass over the texts without a shuffle.

Only labelled rows with crc32(id as text) mod 5 other than 0 teach; labels, lang,
source and ids are never inputs of a score.

Defined results: a null text is empty; an empty text gets the score of a text
without evidence; without usable labels the listed insults alone vote; repeated
rows are separate rows; an empty table gives an empty result; other columns are
left aside.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm.common import checkpoint

#: Common insults in four languages, as a start for the lexicon; the rest is found in the sample.
INSULTS = tuple("idiot moron stupid trash scum loser clown pathetic worthless disgusting imbecile idiote connard ordure crétin salaud dumm arschloch abschaum trottel versager imbécil basura escoria estúpido".split())
SAMPLE = 20_000
VOTERS = 400
LENGTHS = (4, 5, 6, 7, 8)
LEVELS = 3

_WORD = re.compile(r"[^\W\d_]+")


def units(word: str) -> list[str]:
    """The word, and its beginnings (marked by ``~``)."""
    return [word, *(word[:n] + "~" for n in LENGTHS if len(word) >= n)]


def unit_counts(text: str | None, known=None) -> Counter:
    """How often each unit (of ``known``) occurs in a text."""
    out: Counter = Counter()
    for word, n in Counter(_WORD.findall((text or "").lower())).items():
        for u in units(word):
            if known is None or u in known:
                out[u] += n
    return out


def _in_positives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Units of the sampled toxic texts, by the number of texts that hold them."""
    seen: Counter = Counter()
    for batch in batches:
        for text in batch["text"]:
            seen.update(unit_counts(text).keys())
    if seen:
        yield pd.DataFrame({"unit": list(seen), "n": list(seen.values())})


def _counts_of(known: dict[str, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [unit_counts(t, known) for t in batch["text"]]
            yield pd.DataFrame({"label": batch["label"], "unit": [[known[u] for u in f] for f in found], "n": [[min(n, LEVELS) for n in f.values()] for f in found]})

    return run


def _totals_of(known: dict[str, int]):
    """For each unit and level, in how many toxic and other texts of the sample it occurs so often."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(known), LEVELS, 2), np.int64)
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"]):
                for u, n in unit_counts(text, known).items():
                    total[known[u], : min(n, LEVELS), int(label)] += 1
        u, level, label = np.nonzero(total)
        yield pd.DataFrame({"unit": u, "level": level, "label": label, "n": total[u, level, label]})

    return run


class _Sparse:
    """Products with a 0/1 matrix, from the places of its ones."""

    def __init__(self, dense: np.ndarray):
        self.dense = dense
        self.row, self.col = np.nonzero(dense)

    def by_row(self, y: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, y[self.col], len(self.dense))

    def by_col(self, y: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, y[self.row], self.dense.shape[1])

    def together(self, rows: int = 2048) -> np.ndarray:
        """How often two columns are 1 in one row; a block of rows at a time."""
        out = np.zeros((self.dense.shape[1],) * 2)
        for at in range(0, len(self.dense), rows):
            part = self.dense[at : at + rows].astype(np.float32)
            out += part.T @ part
        return out


def label_model(votes: np.ndarray, start: np.ndarray | None = None, *, rounds: int = 30) -> tuple[np.ndarray, dict]:
    """Posterior probability of class 1 for each row of 0/1 votes (the last voter is for class 0), and the estimates.

    A voter's likelihood ratio counts with the weight 1 / sqrt(1 + sum of its absolute correlations with others within the classes),
    between full evidence (none correlated) and one share of it (all the same); firing when others do not counts as repeating them, too.
    """
    n, m = votes.shape
    v = _Sparse(votes)
    post = np.where(votes[:, -1] == 1, 0.02, 0.5) if start is None else start
    weight = np.ones(m)
    for k in range(rounds):
        prior = np.clip(post.mean(), 1e-3, 1 - 1e-3)
        fires1 = (v.by_col(post) + 0.5) / (post.sum() + 1)
        fires0 = (v.by_col(1 - post) + 0.5) / ((1 - post).sum() + 1)
        if k in (2, rounds // 2):
            classes, fires = np.stack([post, 1 - post]), np.stack([fires1, fires0])
            cross = np.stack([v.by_col(c) for c in classes]).T @ fires
            cov = (v.together() - cross - cross.T + fires.T @ (classes @ classes.T) @ fires) / n
            sd = np.sqrt(np.maximum(np.diag(cov), 0)) + 1e-9
            corr = np.clip(np.abs(cov / np.outer(sd, sd)), 0, 1)
            np.fill_diagonal(corr, 0)
            weight = 1 / np.sqrt(1 + corr.sum(axis=1))
        ratio1, ratio0 = np.log(fires1 / fires0), np.log((1 - fires1) / (1 - fires0))
        log_odds = np.log(prior / (1 - prior)) + v.by_row(weight * (ratio1 - ratio0)) + (weight * ratio0).sum()
        was, post = post, 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
        if k > rounds // 2 and np.abs(post - was).max() < 1e-4:
            break
    return post, {"fires1": fires1, "fires0": fires0, "weight": weight, "prior": prior}


def calibration(z: np.ndarray, gold: np.ndarray, *, rounds: int = 100) -> tuple[float, float]:
    """Slope and shift that make 1 / (1 + exp(-(slope * z + shift))) fit the labels best, by damped Newton steps; a score that orders them wrongly keeps a small slope."""
    centre, spread = float(z.mean()), float(z.std()) + 1e-9
    x = np.stack([(z - centre) / spread, np.ones(len(z))], axis=1)
    t = np.where(gold == 1, (gold.sum() + 1) / (gold.sum() + 2), 1 / ((gold == 0).sum() + 2))

    def loss(c: np.ndarray) -> float:
        y = x @ c
        return float((np.logaddexp(0, y) - t * y).mean() + 1e-4 * (c @ c))

    c = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x / len(z) + 2e-4 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (t - p) / len(z) - 2e-4 * c)
        size = 1.0
        while size > 1e-6 and loss(c + size * step) > loss(c):
            size /= 2
        c = c + size * step
        if np.abs(size * step).max() < 1e-7:
            break
    slope = max(float(c[0]), 0.01) / spread
    return slope, float(c[1]) - slope * centre


def logistic(x: np.ndarray, target: np.ndarray, *, decay: float = 1e-3, rounds: int = 400, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression of 0/1 features on soft labels (Adam, full batch)."""
    w, b = np.zeros(x.shape[1]), 0.0
    ones = _Sparse(x)
    m = np.zeros(x.shape[1] + 1)
    s = np.zeros(x.shape[1] + 1)
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(ones.by_row(w) + b, -30, 30)))
        err = p - target
        g = np.append(ones.by_col(err) / len(x) + decay * w, err.mean())
        m = 0.9 * m + 0.1 * g
        s = 0.99 * s + 0.01 * g * g
        step = rate / (1 + k / 50) * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def train(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> dict:
    """The model: unit -> place, weights by place and level, bias."""
    teaches = F.crc32(F.col("_id").cast("string").cast("binary")) % 5 != 0
    rows = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).cast("int").alias("label")).filter(teaches)
    drawn = F.broadcast(rows.orderBy(F.xxhash64("_id"), "_id").limit(sample))
    plain = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter(teaches)
    share = min(1.0, sample / max(plain.count(), 1))
    some = F.shiftrightunsigned(F.xxhash64(F.lit("pool"), "_id"), 11) < F.lit(int(share * 2**53))
    # one row an id, however often it is repeated; -1: no label
    both = plain.join(drawn, "_id", "left").filter(F.col("label").isNotNull() | some).groupBy("_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    held = checkpoint(both.select("text", F.coalesce("label", F.lit(-1)).alias("label")))
    texts = held.filter("label >= 0")
    positives = texts.filter("label = 1")
    n1, n = positives.count(), texts.count()
    found: list[str] = []
    if n1:
        enough = max(3, round(0.01 * n1))
        common = positives.select("text").mapInPandas(_in_positives, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n")).filter(F.col("n") >= enough)
        found = [r.unit for r in common.orderBy(F.desc("n"), "unit").limit(50 * VOTERS).collect()]
    known = {u: k for k, u in enumerate(dict.fromkeys([*INSULTS, *found]))}
    total = np.zeros((len(known), LEVELS, 2))
    for r in texts.mapInPandas(_totals_of(known), "unit long, level long, label long, n long").groupBy("unit", "level", "label").agg(F.sum("n").alias("n")).collect():
        total[r.unit, r.level, r.label] = r.n
    # Entries whose best level tells most, by a smoothed precision and what they reach.
    pos, neg = total[..., 1], total[..., 0]
    precision = (pos + 0.5) / (pos + neg + 0.5 * max(n, 1) / max(n1, 1))
    gain = np.where((precision >= 0.35) & (pos >= 3), pos * (precision - 0.2), 0).max(axis=1)
    chosen = [k for k in np.argsort(-gain, kind="stable")[:VOTERS] if gain[k] > 0]
    names = list(known)
    chosen = {u: k for k, u in enumerate(dict.fromkeys([names[k] for k in chosen] + [u for u in INSULTS]))}

    held = held.mapInPandas(_counts_of(chosen), "label int, unit array<int>, n array<int>").toPandas()  # about 2 * ``sample`` rows of chosen entries
    x = np.zeros((len(held), len(chosen) * LEVELS), np.uint8)
    for k, (us, ns) in enumerate(zip(held["unit"], held["n"])):
        for u, c in zip(us, ns):
            x[k, u * LEVELS : u * LEVELS + c] = 1
    gold = held["label"].to_numpy(np.int64)
    known = gold >= 0
    if not len(held) or not 0 < gold[known].sum() < known.sum():
        w = np.zeros(len(chosen) * LEVELS)
        w[::LEVELS] = [6.0 if u in INSULTS else 0.0 for u in chosen]
        return {"units": chosen, "weights": w.reshape(-1, LEVELS), "bias": -3.0}
    use = x.sum(axis=0) >= 3
    votes = np.concatenate([x[:, use], (x.sum(axis=1) == 0)[:, None].astype(np.uint8)], axis=1)
    post, _ = label_model(votes)
    w, b = logistic(x, post)
    slope, shift = calibration(_Sparse(x[known]).by_row(w) + b, gold[known])
    w, b = slope * w, slope * b + shift
    return {"units": chosen, "weights": w.reshape(-1, LEVELS), "bias": float(b)}


def scorer(model: dict):
    chosen, weights, bias = model["units"], model["weights"], model["bias"]
    upto = np.concatenate([np.zeros((len(weights), 1)), weights.cumsum(axis=1)], axis=1).tolist()

    class Places(dict):
        """Word -> places of its units in the model; remembered up to a number of words."""

        def __missing__(self, word: str):
            if len(self) > 500_000:
                self.clear()
            out = self[word] = tuple(chosen[u] for u in units(word) if u in chosen)
            return out

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        places = Places()
        out = []
        for t in text:
            hits: Counter = Counter()
            for p in map(places.__getitem__, _WORD.findall((t or "").lower())):
                if p:
                    hits.update(p)
            out.append(bias + sum(upto[p][min(n, LEVELS)] for p, n in sorted(hits.items())))
        return pd.Series(1 / (1 + np.exp(-np.clip(np.array(out, float), -30, 30))))

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, held_out, score, predicted) for each row."""
    score = scorer(train(docs, labels, id_col=id_col, text_col=text_col, **options))
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0
    out = docs.select(F.col(id_col), held.alias("held_out"), score(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    from undula.llm.common import read

    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
