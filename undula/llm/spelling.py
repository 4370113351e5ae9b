"""Spelling variants: words one edit apart, grouped under their most frequent form.

The words of all texts are counted, and those that are long and frequent enough
are cut by range of (length class, word) into shards of a bounded size.  A shard
is a compact trie: nodes of a level lie in one row of arrays, the children of a
node side by side, and a node that only one word reaches is a leaf with the rest
of its word as a tail.  Shards are broadcast in passes of bounded bytes; each
task takes blocks of words and intersects the distance-one Levenshtein automaton
of every word with every shard, depth-first: a stack holds groups of states
(word, node, edits so far), a group beyond a size is split, and the group made
last goes on first.  Counts and best forms are reduced in the task, per length
class, and then by word.

An edit in a run of equal letters has several places; the automaton takes the
last, so that a neighbour is given out once.

Forms lead to words at least ten times as frequent, so chains are short; roots are
found by doubling.

Defined results: null and empty texts have no words; a null id counts as an empty
text; repeated rows count again; an empty table gives an empty result; other
columns are not read.  Runs of any length are whole words.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm.common import checkpoint, join_split, partitions, read

#: Letters of a word: one byte each in Latin-1, in the order of their code points.
LETTERS = "A-Za-z\\u00C0-\\u00FF"
#: A group of more states than this is split.
STATES = 1 << 17


# -- words ---------------------------------------------------------------------


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def misspelt(doc_id: Column, run: Column, every: int) -> Column:
    """``run`` without one letter if ``every`` divides the crc32 of ``id:run``, as the contract of the query wants it."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % every == 0, cut).otherwise(run)


def word_counts(runs: DataFrame, *, least_length: int = 7, least_count: int = 2) -> DataFrame:
    """(word, n) of the words of column ``word`` that are long and frequent enough."""
    counted = runs.filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= least_count)


def letter_runs(docs: DataFrame, *, text: str = "text", least_length: int = 7) -> DataFrame:
    """(doc_id, run): maximal runs of letters with at least ``least_length`` of them, A-Z in lower case."""
    found = F.regexp_extract_all(lowered(F.col(text)), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("run"))


# -- tries ---------------------------------------------------------------------


class Trie:
    """Words of one length class in order, as a compact trie.

    ``words`` is a matrix of bytes padded by zeros, ``sizes`` and ``counts`` are theirs; ``fan``, ``label`` and ``first_word`` belong to nodes.
    Node 0 is the root; the children of node i are the nodes from 1 + the sum of ``fan`` before i.  A node without children is a leaf.
    """

    def __init__(self, words: np.ndarray, sizes: np.ndarray, counts: np.ndarray):
        self.words, self.sizes, self.counts = words, sizes, counts
        n, width = words.shape
        differ = words[1:] != words[:-1]
        shared = np.concatenate([[-1], np.where(differ.any(1), differ.argmax(1), width), [-1]]).astype(np.int32)
        before, after = shared[:-1], shared[1:]
        alone = np.minimum(sizes, np.maximum(before, after) + 1)  # the last depth at which the word has a node of its own making
        fans, labels, firsts, above = [], [np.zeros(1, np.uint8)], [np.zeros(1, np.int32)], np.zeros(1, np.int64)
        for depth in range(1, int(alone.max()) + 1):
            starts = np.flatnonzero((before < depth) & (alone >= depth))
            fans.append(np.bincount(np.searchsorted(above, starts, side="right") - 1, minlength=len(above)))
            labels.append(words[starts, depth - 1])
            firsts.append(starts.astype(np.int32))
            above = starts
        fans.append(np.zeros(len(above), np.int64))
        self.fan, self.label, self.first_word = np.concatenate(fans).astype(np.uint8), np.concatenate(labels), np.concatenate(firsts)

    def packed(self) -> bytes:
        return pickle.dumps((self.words, self.sizes, self.counts, self.fan, self.label, self.first_word), protocol=5)

    @classmethod
    def unpacked(cls, data: bytes) -> Trie:
        trie = cls.__new__(cls)
        trie.words, trie.sizes, trie.counts, trie.fan, trie.label, trie.first_word = pickle.loads(data)
        fan = trie.fan.astype(np.int64)
        trie.child = 1 + np.cumsum(fan) - fan
        parent = np.repeat(np.arange(len(fan)), fan)
        trie.key = parent * 256 + trie.label[1:]
        bit = np.uint64(1) << (trie.label[1:] & 63).astype(np.uint64)
        trie.mask = np.zeros(len(fan), np.uint64)
        inner = np.flatnonzero(fan)
        if len(inner):
            trie.mask[inner] = np.bitwise_or.reduceat(bit, trie.child[inner] - 1)
        return trie

    def text(self, k: int) -> str:
        return self.words[k, : self.sizes[k]].tobytes().decode("latin-1")


def _one_edit(q: np.ndarray, m: np.ndarray, t: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether rows q of lengths m and rows t of lengths k, of one width, are exactly one edit apart."""
    place = np.arange(q.shape[1])
    differ = q != t
    first = np.where(differ.any(1), differ.argmax(1), q.shape[1])[:, None]
    ok = (m == k) & (differ.sum(1) == 1)
    longer_t = ((t[:, 1:] == q[:, :-1]) | (place[:-1] < first)).all(1)
    longer_q = ((q[:, 1:] == t[:, :-1]) | (place[:-1] < first)).all(1)
    return ok | ((k == m + 1) & longer_t) | ((m == k + 1) & longer_q)


def neighbours(q: np.ndarray, sizes: np.ndarray, trie: Trie) -> tuple[np.ndarray, np.ndarray]:
    """(rows of q, words of the trie) at distance one, each pair once.

    ``q`` has words padded by zeros, at least two of them in each row.
    """
    width = max(q.shape[1], trie.words.shape[1] + 2)
    q = np.pad(q, ((0, 0), (0, width - q.shape[1])))
    words = np.pad(trie.words, ((0, 0), (0, width - trie.words.shape[1])))
    no = np.zeros(0, np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    near = np.flatnonzero((sizes >= trie.sizes.min() - 1) & (sizes <= trie.sizes.max() + 1))
    # A group of states: depth; words and nodes without an edit so far; words, nodes and shifts (place in the word less depth) after one.
    stack = [(0, near, np.zeros(len(near), np.int64), no, no, no)]
    while stack:
        depth, w, node, w1, node1, shift = stack.pop()
        if len(w) + len(w1) > STATES:
            a, b = len(w) // 2, len(w1) // 2
            stack += [(depth, w[a:], node[a:], w1[b:], node1[b:], shift[b:]), (depth, w[:a], node[:a], w1[:b], node1[:b], shift[:b])]
            continue
        leaf = trie.fan[node1] == 0
        # After the edit, the rest of a leaf's word must be the rest of the word.
        lw, lt, ls = w1[leaf], trie.first_word[node1[leaf]], shift[leaf]
        fits = trie.sizes[lt] == sizes[lw] - ls
        lw, lt, ls = lw[fits], lt[fits], ls[fits]
        for s in (-1, 0, 1):
            at = np.flatnonzero(ls == s)
            same = (q[lw[at], depth + s : width + min(s, 0)] == words[lt[at], depth : width - max(s, 0)]).all(1) if depth + s >= 0 else np.zeros(len(at), bool)
            found.append((lw[at][same], lt[at][same]))
        # At a node that ends a word, the word may end too.
        w1, node1, shift = w1[~leaf], node1[~leaf], shift[~leaf]
        ends = depth + shift == sizes[w1]
        t = trie.first_word[node1[ends]]
        whole = trie.sizes[t] == depth
        found.append((w1[ends][whole], t[whole]))
        w1, node1, shift = w1[~ends], node1[~ends], shift[~ends]
        need = q[w1, depth + shift]
        has = (trie.mask[node1] >> (need & 63).astype(np.uint64)) & np.uint64(1) == 1
        w1, node1, shift, need = w1[has], node1[has], shift[has], need[has]
        key = node1 * 256 + need
        at = np.minimum(np.searchsorted(trie.key, key), len(trie.key) - 1)
        hit = trie.key[at] == key if len(trie.key) else np.zeros(0, bool)
        more = [(w1[hit], at[hit] + 1, shift[hit])]
        # Without an edit so far: a leaf's word is compared whole.
        leaf = trie.fan[node] == 0
        lw, lt = w[leaf], trie.first_word[node[leaf]]
        one = _one_edit(q[lw], sizes[lw], words[lt], trie.sizes[lt])
        found.append((lw[one], lt[one]))
        w, node = w[~leaf], node[~leaf]
        last = depth == sizes[w] - 1  # the word's last letter is left out
        t = trie.first_word[node[last]]
        whole = trie.sizes[t] == depth
        found.append((w[last][whole], t[whole]))
        fan = trie.fan[node].astype(np.int64)
        each = np.repeat(np.arange(len(w)), fan)
        child = np.repeat(trie.child[node] - (np.cumsum(fan) - fan), fan) + np.arange(len(each))
        ew, label = w[each], trie.label[child]
        here, next_ = q[ew, depth], q[ew, depth + 1]
        match = label == here
        swap, left_out = ~match & (here != 0), (label == next_) & (here != next_)
        for chosen, s in ((swap, 0), (~match, -1), (left_out, 1)):
            more.append((ew[chosen], child[chosen], np.full(int(chosen.sum()), s, np.int64)))
        w, node = ew[match], child[match]
        w1, node1, shift = (np.concatenate(x) for x in zip(*more))
        if len(w) + len(w1):
            stack.append((depth + 1, w, node, w1, node1, shift))
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*found))


# -- shards and passes -----------------------------------------------------------


def _shards(most_words: int, most_bytes: int):
    """Words that come in order of (class, word), as packed tries of bounded size."""

    def made(held: list[tuple[int, bytes, int]]) -> pd.DataFrame:
        sizes = np.array([len(w) for _, w, _ in held], np.int32)
        width = int(sizes.max())
        words = np.frombuffer(b"".join(w.ljust(width, b"\0") for _, w, _ in held), np.uint8).reshape(len(held), width)
        data = Trie(words, sizes, np.array([n for _, _, n in held], np.int64)).packed()
        return pd.DataFrame({"shard": [f"{held[0][0]:03d}:{held[0][1].decode('latin-1')}"], "class": [held[0][0]], "bytes": [len(data)], "trie": [data]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, bytes, int]] = []
        for batch in batches:
            for c, w, n in zip(batch["class"], batch["word"], batch["n"]):
                if held and (held[0][0] != c or len(held) >= most_words or (len(held) + 1) << c > most_bytes):
                    yield made(held)
                    held = []
                held.append((c, w.encode("latin-1"), n))
        if held:
            yield made(held)

    return run


def _best(w: np.ndarray, n: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each value of w, the place of the largest n, of equals the one of least order."""
    by = np.lexsort((order, -n, w))
    return by[np.concatenate([[True], w[by][1:] != w[by][:-1]])] if len(by) else by


def _looked_up(told, first_pass: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes = {}
        for c, data in told.value:
            classes.setdefault(c, []).append(Trie.unpacked(data))
        for batch in batches:
            for data in batch["trie"]:
                block = Trie.unpacked(data)
                text = [block.text(k) for k in range(len(block.sizes))]
                if first_pass:
                    yield pd.DataFrame({"word": text, "n": block.counts, "n_near": 0, "form": None, "form_n": None})
                for tries in classes.values():
                    parts = [(*neighbours(block.words, block.sizes, trie), k) for k, trie in enumerate(tries)]
                    w = np.concatenate([p[0] for p in parts])
                    if not len(w):
                        continue
                    t, k = np.concatenate([p[1] for p in parts]), np.concatenate([np.full(len(p[0]), p[2]) for p in parts])
                    n = np.concatenate([tries[p[2]].counts[p[1]] for p in parts])
                    best, n_near = _best(w, n, k * (1 << 32) + t), np.bincount(w, minlength=len(text))
                    yield pd.DataFrame({
                        "word": [text[i] for i in w[best]], "n": block.counts[w[best]], "n_near": n_near[w[best]],
                        "form": [tries[a].text(b) for a, b in zip(k[best], t[best])], "form_n": n[best],
                    })

    return run


def near_words(words: DataFrame, *, shard_words: int = 50_000, shard_bytes: int = 8_000_000, pass_bytes: int = 128_000_000) -> DataFrame:
    """(word, n, n_near, form, form_n) of (word, n): the number of words at distance one, and the most frequent of them.

    A shard has at most ``shard_words`` words, and ``shard_bytes`` of them if it has more than one; a pass broadcasts ``pass_bytes`` of shards or a single shard.
    """
    spark = words.sparkSession
    # Class c holds words of more than 2 ** (c - 1) and at most 2 ** c letters.
    classed = words.withColumn("class", F.ceil(F.log2(F.length("word").cast("double"))).cast("int"))
    ordered = checkpoint(classed).repartitionByRange(partitions(spark), "class", "word").sortWithinPartitions("class", "word")
    shards = checkpoint(ordered.mapInPandas(_shards(shard_words, shard_bytes), "shard string, class int, bytes long, trie binary"))
    # A row of a few bytes for each shard decides which shards make up a pass.
    passes, left = [[]], pass_bytes
    for row in shards.select("shard", "class", "bytes").orderBy("class", "shard").toLocalIterator():
        if row["bytes"] > left and passes[-1]:
            passes, left = [*passes, []], pass_bytes
        passes[-1].append(row["shard"])
        left -= row["bytes"]
    blocks = shards.select("trie").repartition(partitions(spark))
    found = []
    for k, names in enumerate(passes):
        rows = shards.filter(F.col("shard").isin(names)).select("class", "shard", "trie").collect() if names else []
        told = spark.sparkContext.broadcast([(r["class"], r["trie"]) for r in sorted(rows, key=lambda r: (r["class"], r["shard"]))])
        looked_up = blocks.mapInPandas(_looked_up(told, k == 0), "word string, n long, n_near long, form string, form_n long")
        found.append(looked_up if len(passes) == 1 else checkpoint(looked_up))
        if len(passes) > 1:
            told.unpersist()
    rows = found[0]
    for other in found[1:]:
        rows = rows.unionByName(other)
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), F.col("form"))))
    reduced = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    return reduced.select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def with_roots(words: DataFrame) -> DataFrame:
    """Adds ``root``: where the forms of (word, form, ...) lead to in the end.  Forms must not run in a circle."""
    words = checkpoint(words)
    found = checkpoint(words.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    while True:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = checkpoint(join_split(found, onward, ["root"], how="left"))
        if step.filter(F.col("_next").isNotNull()).isEmpty():
            break
        found = step.select("word", F.coalesce("_next", "root").alias("root"))
    return words.join(found, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(words: DataFrame, *, factor: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of (word, n): a form has at least ``factor`` times the word's n."""
    if factor < 2:
        raise ValueError("factor must be 2 or more, or forms could run in a circle")
    far = near_words(words)
    enough = F.col("form_n") >= factor * F.col("n")
    formed = far.select("word", F.when(enough, F.col("form")).alias("form"), "n", "n_near", F.when(enough, F.col("form_n")).alias("form_n"))
    return with_roots(formed).select("word", "form", "root", "n", "n_near", "form_n")


# -- query -----------------------------------------------------------------------


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of the words of all documents."""
    runs = letter_runs(read(spark, sf_dir, "documents"))
    return spelling_variants(word_counts(runs.select(misspelt(F.col("doc_id"), F.col("run"), 31).alias("word"))))


#: CRC-32 is worked out byte by byte from a table made by its rule; near words meet in patterns with one letter left out or unknown.
ORACLE = """
WITH RECURSIVE crc AS (SELECT list(c ORDER BY b) AS t FROM (
  SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS b))),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]{7,}')) AS run FROM documents),
hexed AS (SELECT run, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs),
hashed AS (SELECT run, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM hexed, crc),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed),
words AS MATERIALIZED (SELECT word, count(*) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
places AS MATERIALIZED (SELECT word, n, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT x.word, x.n, y.word AS form, y.n AS form_n FROM places x JOIN places y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, x.n, y.word, y.n FROM places x JOIN words y ON y.word = x.a || x.b
  UNION SELECT y.word, y.n, x.word, x.n FROM places x JOIN words y ON y.word = x.a || x.b),
best AS (SELECT word, n, count(*) AS n_near, arg_min(form, (-form_n, form)) AS form, max(form_n) AS form_n FROM near GROUP BY word, n),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * w.n THEN form END AS form, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, 0 AS depth FROM formed UNION ALL SELECT c.word, f.form, depth + 1 FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM formed f JOIN (SELECT word, arg_max(root, depth) AS root FROM chain GROUP BY word) USING (word)
"""
