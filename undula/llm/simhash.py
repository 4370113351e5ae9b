"""SimHash near-duplicates by a binary trie self-join.

A document's fingerprint has a bit for each of 64 positions: 1 if the bit is set
in over half the hashes of its word shingles.  Documents with one fingerprint
are collapsed first.  The distinct fingerprints then form a binary trie that is
joined with itself: pairs of nodes are traversed together, differing bits are
added up, and a pair is dropped once they exceed the budget.

To spread this over tasks, a budget of k bits is met by k + 1 tries, each over
the bits rotated so that another of k + 1 segments leads.  Two fingerprints
within the budget agree in one whole segment, so in one of the tries they lie
below one node at that depth; the subtries at that depth are the units of work.
Nothing is lost, and no task sees more than its subtries.

Inside a subtrie only connectivity matters: a pair of nodes whose leaves are all
in one component already is dropped too, so a dense group of near copies costs
no more than its links need, and a star of links per component leaves the task.

``near_duplicates`` is for shingle similarity, and exact.  The trie join over fingerprints
of five-word shingles gives candidate groups: dense groups of near copies are found
there, at the cost of their links.  No Hamming budget that a trie can meet covers all
pairs at 0.8, so a prefix filter adds what may be missing: two sets of a similarity
share a shingle of their prefixes, the first n - ceil(similarity * n) + 1 of n
shingles in any one order, here with common ones last.  Shingles that only one prefix
holds are dropped first; pairs of the other lists that sizes and parities do not rule
out (a lower bound of the shingles that differ) join the candidate groups.  Long lists
are split over tasks.  Inside a group the shingle sets decide.  The members of a large
group are first compared with a few of them; those that this links need no pairs among
themselves, and the rest is compared in blocks, each pair of blocks a unit of work.

Defined results: a null text is empty; texts without words have fingerprint zero
and are linked like any other; repeated rows and rows with one id get one
component; rows whose id is null are grouped by fingerprint but get a null
component unless the group has an id; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm.common import checkpoint, join_split, partitions, told
from undula.llm.components import components

#: Up to so many ids (8 bytes each) a list of ids is broadcast; beyond, it is joined by shuffle.
BROADCAST_IDS = 500_000
SEED = 42


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 (seed 42) of each n-word shingle, repeats included; A-Z lower-cased, words split at ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[n - 1 :] - 1).tolist())], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; as a signed long."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        count += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, *, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint long) for each row; texts do not leave the task that reads them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "fingerprint": np.array([simhash(shingle_hashes(t, words)) for t in batch["text"]], np.int64)})

    return docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id string, fingerprint long").withColumn("id", F.col("id").cast("long"))


class _Links:
    """Components of the rows of one task; ``tell`` keeps the smallest row as the label."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Link rows a[i] and b[i]."""
        x, y = self.label[a], self.label[b]
        differ = x != y
        if not differ.any():
            return
        pairs = np.unique(np.stack([np.maximum(x, y)[differ], np.minimum(x, y)[differ]], axis=1), axis=0)
        nodes, at = np.unique(pairs, return_inverse=True)
        at = at.reshape(-1, 2)
        low = np.arange(len(nodes))
        while True:  # labels of the touched components, to their fixed point
            new = low.copy()
            np.minimum.at(new, at[:, 0], low[at[:, 1]])
            np.minimum.at(new, at[:, 1], low[at[:, 0]])
            new = np.minimum(new, new[new])
            if (new == low).all():
                break
            low = new
        to = np.arange(len(self.label))
        to[nodes] = nodes[low]
        self.label = to[self.label]

    def run_ends(self) -> np.ndarray:
        """For each row, where the run of equal labels that it lies in ends."""
        n = len(self.label)
        cuts = np.append(np.flatnonzero(self.label[1:] != self.label[:-1]) + 1, n)
        return cuts[np.searchsorted(cuts, np.arange(n), side="right")]


def _expand(pl, ph, ql, qh):
    """All pairs of rows of each pair of intervals."""
    m, n = ph - pl, qh - ql
    total = m * n
    which = np.repeat(np.arange(len(pl)), total)
    k = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    return pl[which] + k // n[which], ql[which] + k % n[which]


def trie_links(value: np.ndarray, start: np.ndarray, end: np.ndarray, depth: int, budget: int, *, leaf: int = 1024, step: int = 1 << 22, frontier: int = 1 << 20) -> np.ndarray:
    """Component labels of rows linked within ``budget`` bits.

    ``value``: sorted uint64; ``start``, ``end``: the intervals of rows that share their first ``depth`` bits.
    Pairs of nodes are intervals of rows, at most ``frontier`` pairs of a depth are walked down at a time.
    A pair of at most ``leaf`` pairs of rows is compared at once, ``step`` at a time.
    """
    links = _Links(len(value))
    if len(value) > 1:
        same = np.searchsorted(start, np.arange(len(value)), side="right")
        near = np.flatnonzero((same[1:] == same[:-1]) & (np.bitwise_count(value[1:] ^ value[:-1]) <= budget))
        links.join(near, near + 1)
    keep = end - start > 1
    waiting = [(depth, np.stack([start[keep], end[keep], start[keep], end[keep], np.zeros(keep.sum(), np.int64)]))]
    while waiting:
        depth, pairs = waiting.pop()
        if pairs.shape[1] > frontier:
            waiting.append((depth, pairs[:, frontier:]))
            pairs = pairs[:, :frontier]
        runs = links.run_ends()
        pl, ph, ql, qh, _ = pairs
        known = (runs[pl] >= ph) & (runs[ql] >= qh) & (links.label[pl] == links.label[ql])
        pl, ph, ql, qh, err = pairs[:, ~known]
        small = ((ph - pl) * (qh - ql) <= leaf) | (depth >= 64)
        for part in np.array_split(np.flatnonzero(small), max(1, int(((ph - pl) * (qh - ql))[small].sum() // step))):
            a, b = _expand(pl[part], ph[part], ql[part], qh[part])
            ok = np.bitwise_count(value[a] ^ value[b]) <= budget
            links.join(a[ok], b[ok])
        pl, ph, ql, qh, err = (x[~small] for x in (pl, ph, ql, qh, err))
        if not len(pl):
            continue
        bit = np.uint64(1) << np.uint64(63 - depth)
        below = np.uint64(2**64 - 1) << np.uint64(63 - depth)

        def middle(lo, hi):
            return np.clip(np.searchsorted(value, (value[lo] | bit) & below), lo, hi)

        pm, qm, own = middle(pl, ph), middle(ql, qh), pl == ql
        made = [(pl, pm, ql, qm, err), (pm, ph, qm, qh, err), (pl, pm, qm, qh, err + 1)]
        made.append(tuple(x[~own] for x in (pm, ph, ql, qm, err + 1)))
        pairs = np.concatenate([np.stack(x) for x in made], axis=1)
        pl, ph, ql, qh, err = pairs
        waiting.append((depth + 1, pairs[:, (pl < ph) & (ql < qh) & (err <= budget) & ~((pl == ql) & (ph - pl < 2))]))
    return links.label


def _in_groups(batches: Iterator[pd.DataFrame], keys: list[str], rows: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by ``keys``, cut between groups, about ``rows`` at a time."""
    held: list[pd.DataFrame] = []
    count = 0
    for batch in batches:
        if not len(batch):
            continue
        k = batch[keys].to_numpy()
        last = np.flatnonzero((k != k[-1]).any(axis=1))
        cut = int(last[-1]) + 1 if len(last) else 0
        if not cut and held and (held[-1][keys].iloc[-1].to_numpy() != k[0]).any() and count >= rows:
            yield pd.concat(held, ignore_index=True)
            held, count = [], 0
        if cut and count + len(batch) >= rows:
            yield pd.concat([*held, batch.iloc[:cut]], ignore_index=True)
            held, count, batch = [], 0, batch.iloc[cut:]
        held.append(batch)
        count += len(batch)
    if count:
        yield pd.concat(held, ignore_index=True)


def _starts(*keys: np.ndarray) -> np.ndarray:
    change = np.zeros(len(keys[0]), bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def _star(label: np.ndarray, rep: np.ndarray) -> pd.DataFrame:
    """Links of each row to the smallest rep of its component."""
    order = np.lexsort((rep, label))
    lab, r = label[order], rep[order]
    first = _starts(lab)
    root = np.repeat(r[first], np.diff(np.append(first, len(lab))))
    return pd.DataFrame({"a": r[r != root], "b": root[r != root]})


def hamming_links(prints: DataFrame, *, max_bits: int = 4, segments: int | None = None) -> DataFrame:
    """(rep, fingerprint), distinct fingerprints -> links (a, b) with the components of all pairs within ``max_bits``."""
    segments = segments or max_bits + 1
    if segments <= max_bits:
        raise ValueError("segments must exceed max_bits, or pairs would be lost")
    cuts = [64 * k // segments for k in range(segments + 1)]
    depth = min(b - a for a, b in zip(cuts, cuts[1:]))
    value = F.col("fingerprint")
    tries = F.array(*(F.struct(F.lit(k).alias("trie"), (F.shiftleft(value, a).bitwiseOR(F.shiftrightunsigned(value, 64 - a)) if a else value).alias("v")) for k, a in enumerate(cuts[:-1])))
    rows = prints.select("rep", F.inline(tries)).withColumn("lead", F.shiftrightunsigned("v", 64 - depth))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _in_groups(batches, ["trie", "lead"], 1 << 18):
            lead = group["trie"].to_numpy(np.int64) << depth | group["lead"].to_numpy(np.int64)
            v = group["v"].to_numpy(np.int64).view(np.uint64)
            rep = group["rep"].to_numpy(np.int64)
            first = _starts(lead)
            for trie in np.unique(lead >> depth):
                a, b = np.searchsorted(lead, [trie << depth, (trie + 1) << depth])
                mine = first[(first >= a) & (first < b)] - a
                order = np.argsort(v[a:b], kind="stable")
                yield _star(trie_links(v[a:b][order], mine, np.append(mine[1:], b - a), depth, max_bits), rep[a:b][order])

    dealt = rows.repartition(partitions(prints.sparkSession), "trie", "lead").sortWithinPartitions("trie", "lead")
    return dealt.mapInPandas(run, "a long, b long")


def simhash_groups(docs: DataFrame, *, words: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint long, component long): the smallest id that a document reaches over links of at most ``max_bits``."""
    prints = checkpoint(fingerprints(docs, words=words, id_col=id_col, text_col=text_col))
    reps = checkpoint(prints.groupBy("fingerprint").agg(F.min("id").alias("rep")))
    found = components(hamming_links(reps.filter("rep IS NOT NULL"), max_bits=max_bits))
    labels = reps.join(found, reps["rep"] == found["node"], "left").select("fingerprint", F.coalesce("component", "rep").alias("component"))
    return join_split(prints, labels, ["fingerprint"]).select("id", "fingerprint", "component")


#: Bits of the parities of a shingle set: about one for each shingle, a power of two, at most so many.
MOST_BITS = 8192
BLOCK = 128  # documents in a block of a candidate group
PIVOTS = 32  # members of a large candidate group that all others are compared with first
SALT = 4096  # members that one task compares with them
#: Rows of a list that one task compares; longer lists are split.
LIST = 4096
#: Documents on which common shingles are counted. They only order the shingles; no result depends on them.
SAMPLED = 4_000


def common_shingles(docs: DataFrame, *, words: int, text_col: str, n: int) -> np.ndarray:
    """Shingles of some in a thousand documents, the rarest first, by a sample."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"token": np.concatenate([np.zeros(0, np.uint64), *(np.unique(shingle_hashes(t, words)) for t in batch["text"])]).view(np.int64)})

    some = docs.sample(min(1.0, SAMPLED / max(n, 1)), SEED).select(F.col(text_col).alias("text"))
    found = some.mapInPandas(run, "token long").groupBy("token").count().filter("count >= 4").orderBy(F.desc("count"), "token").limit(100_000)
    return np.array([r.token for r in found.collect()][::-1], np.int64).view(np.uint64)


def prefix(found: np.ndarray, common: np.ndarray, similarity: float) -> tuple[np.ndarray, int]:
    """The first shingles of a set, and how many of them are not common: two sets of at least ``similarity`` share one of
    them, whatever the order is.  Common ones come last."""
    size = len(found) - math.ceil(similarity * len(found) - 1e-9) + 1 if len(found) else 0
    if not len(common):
        return found[:size], size
    rank = np.argsort(common)
    at = np.minimum(np.searchsorted(common[rank], found), len(common) - 1)
    is_common = common[rank][at] == found
    late = found[is_common][np.argsort(rank[at[is_common]])]
    return np.concatenate([found[~is_common], late])[:size], min(size, len(found) - len(late))


def parities(found: np.ndarray) -> bytes:
    """Whether the number of shingles whose hash ends in k is odd, for each k below a power of two of about the set's size.

    Two sets differ in at least as many shingles as their parities in bits, also after folding the longer onto the shorter.
    """
    size = min(MOST_BITS, max(64, 1 << (len(found) - 1).bit_length())) if len(found) else 64
    return np.packbits(np.bincount((found & found.dtype.type(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1).tobytes()


class _Parities:
    """Parities of the rows of a task, compared pair by pair."""

    def __init__(self, rows: list[bytes]):
        self.rows = [np.frombuffer(r, np.uint64) for r in rows]
        self.words = np.array([len(r) for r in self.rows], np.int64)
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _at(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and parities of the rows that can be compared at so many words: those of that length and of twice."""
        if words not in self.folded:
            at = np.flatnonzero((self.words == words) | (self.words == 2 * words))
            place = np.full(len(self.rows), -1)
            place[at] = np.arange(len(at))
            self.folded[words] = place, np.stack([np.bitwise_xor.reduce(self.rows[k].reshape(-1, words), axis=0) for k in at])
        return self.folded[words]

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Differing bits of the rows a[i] and b[i], whose lengths are at most a factor of two apart."""
        words, out = np.minimum(self.words[a], self.words[b]), np.zeros(len(a), np.int64)
        for w in np.unique(words).tolist():
            mine = np.flatnonzero(words == w)
            place, data = self._at(w)
            for part in np.array_split(mine, max(1, len(mine) * w >> 20)):
                out[part] = np.bitwise_count(data[place[a[part]]] ^ data[place[b[part]]]).sum(axis=1)
        return out


def set_prints(docs: DataFrame, common: np.ndarray, similarity: float, *, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, x0, x1, fingerprint, n, w, rare, prefix): a digest of the words, the SimHash, and of the shingle set its size, parities and
    prefix, of which the first ``rare`` are not common."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                made = []
                for id_, text in zip(batch["id"].iloc[at : at + 512], batch["text"].iloc[at : at + 512]):
                    hashes = shingle_hashes(text, words)
                    found = np.unique(hashes)
                    first, rare = prefix(found, shared.value, similarity)
                    x = np.frombuffer(xxhash.xxh3_128_digest(b" ".join((text or "").encode().lower().split())), np.int64)
                    made.append((id_, x[0], x[1], simhash(hashes), len(found), parities(found), rare, first.view(np.int64)))
                yield pd.DataFrame(made, columns=["id", "x0", "x1", "fingerprint", "n", "w", "rare", "prefix"])

    schema = "id string, x0 long, x1 long, fingerprint long, n int, w binary, rare int, prefix array<long>"
    return docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, schema).withColumn("id", F.col("id").cast("long"))


def shared_tokens(rows: DataFrame) -> DataFrame:
    """The rows (token, rep) whose token another row has too; runs of equal tokens are passed through, not held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, told = None, False  # the last row, and whether it has been given out
        for batch in batches:
            if not len(batch):
                continue
            whole = batch if held is None else pd.concat([held, batch], ignore_index=True)
            token = whole["token"].to_numpy()
            same = token[1:] == token[:-1]
            keep = np.append(same, False) | np.append(False, same)
            if told:
                keep[0] = False
            held, told = whole.iloc[-1:], bool(keep[-1]) or (told and len(whole) == 1)
            yield whole[keep]

    dealt = rows.repartition(partitions(rows.sparkSession), "token").sortWithinPartitions("token")
    return dealt.mapInPandas(run, "token long, rep long")


def _within(w: _Parities, n: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows whose sizes and differing bits do not rule ``similarity`` out, and those bits.  No pair that has it is lost."""
    live = np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]) - 1e-9
    a, b = a[live], b[live]
    bits = w.differ(a, b)
    live = bits <= (1 - similarity) / (1 + similarity) * (n[a] + n[b]) + 1e-9
    return a[live], b[live], bits[live]


def _block_pairs(start: np.ndarray, end: np.ndarray, side: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows inside the intervals, about ``size`` at a time, by squares of ``side`` rows."""
    big = end - start > 1
    n = -(-(end[big] - start[big]) // side)
    lo = np.repeat(start[big], n) + side * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    hi = np.minimum(lo + side, np.repeat(end[big], n))
    last = np.repeat(np.cumsum(n), n)
    i, j = _expand(np.arange(len(lo)), np.arange(len(lo)) + 1, np.arange(len(lo)), last)
    total = np.cumsum((hi[i] - lo[i]) * (hi[j] - lo[j]))
    for part in np.split(np.arange(len(i)), np.flatnonzero(np.diff(total // size)) + 1) if len(i) else ():
        a, b = _expand(lo[i[part]], hi[i[part]], lo[j[part]], hi[j[part]])
        yield a[a < b], b[a < b]


def list_links(rows: DataFrame, similarity: float) -> DataFrame:
    """(token, rep, n, label, w) -> links (a, b) with the components of the pairs that share a token and may be similar enough, or a label."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _in_groups(batches, ["token"], 1 << 15):
            w, n = _Parities(group["w"].to_list()), group["n"].to_numpy(np.int64)
            first = _starts(group["token"].to_numpy())
            rep, links = np.unique(group["rep"].to_numpy(np.int64), return_inverse=True)
            joined = _Links(len(rep))
            _, at, label = np.unique(group["label"].to_numpy(np.int64), return_index=True, return_inverse=True)
            joined.join(links, links[at][label])
            for a, b in _block_pairs(first, np.append(first[1:], len(group)), 1024, 1 << 20):
                apart = joined.label[links[a]] != joined.label[links[b]]
                a, b, _ = _within(w, n, a[apart], b[apart], similarity)
                joined.join(links[a], links[b])
            yield _star(joined.label, rep)

    dealt = rows.repartition(partitions(rows.sparkSession), "token").sortWithinPartitions("token")
    return dealt.mapInPandas(run, "a long, b long")


def split_links(rows: DataFrame, big: DataFrame, near: DataFrame, similarity: float) -> DataFrame:
    """The same for the long lists ``big`` (token, count), given links ``near`` of the others.

    All rows of a list are first compared with one of them.  Rows of the component that then holds most of a list need no
    pairs among themselves: they are dealt over blocks, and only the rest of the list goes to every block.
    """

    def with_pivot(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            k = np.arange(len(batch))
            w = _Parities([*batch["w"], *batch["pivot_w"]])
            a, b, _ = _within(w, np.concatenate([batch["n"], batch["pivot_n"]]).astype(np.int64), k, k + len(batch), similarity)
            yield pd.DataFrame({"a": batch["rep"].to_numpy()[a], "b": batch["pivot"].to_numpy()[a]})

    rows = rows.join(told(big), "token")
    pivot = checkpoint(rows.groupBy("token").agg(F.min(F.struct(F.xxhash64("rep").alias("h"), "rep", "n", "w")).alias("p")))
    asked = rows.join(told(pivot), "token").select("rep", "n", "w", F.col("p.rep").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.w").alias("pivot_w"))
    near = checkpoint(near.union(asked.mapInPandas(with_pivot, "a long, b long")).filter("a <> b").distinct())
    found = components(near)
    held = checkpoint(rows.join(found, rows["rep"] == found["node"], "left").select("token", "count", "rep", "n", "w", F.coalesce("component", "rep").alias("label")))
    most = checkpoint(held.groupBy("token", "label").agg(F.count("*").alias("m")).groupBy("token").agg(F.max(F.struct("m", "label")).alias("most")))
    held = held.join(told(most), "token").filter("most.m < count").withColumn("rest", F.col("label") != F.col("most.label"))
    blocks = F.ceil(F.col("count") / LIST).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    units = held.select("token", "rep", "n", "w", "label", "rest", own.alias("own"), F.explode(F.when(F.col("rest"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own))).alias("block"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _in_groups(batches, ["token", "block"], 1 << 14):
            w, n = _Parities(group["w"].to_list()), group["n"].to_numpy(np.int64)
            rep, label, rest = (group[c].to_numpy() for c in ("rep", "label", "rest"))
            mine = group["own"].to_numpy() == group["block"].to_numpy()
            first = _starts(group["token"].to_numpy(), group["block"].to_numpy())
            joined = _Links(len(group))
            for lo, hi in zip(first.tolist(), np.append(first[1:], len(group)).tolist()):
                loose, here = lo + np.flatnonzero(rest[lo:hi]), lo + np.flatnonzero(mine[lo:hi])
                for part in np.array_split(loose, max(1, len(loose) * len(here) >> 20)):
                    a, b = np.repeat(part, len(here)), np.tile(here, len(part))
                    apart = (label[a] != label[b]) & (joined.label[a] != joined.label[b])
                    a, b, _ = _within(w, n, a[apart], b[apart], similarity)
                    joined.join(a, b)
            yield _star(joined.label, rep.astype(np.int64))

    dealt = units.repartition(partitions(rows.sparkSession), "token", "block").sortWithinPartitions("token", "block")
    return near.union(dealt.mapInPandas(run, "a long, b long"))


def pivot_links(members: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of the members (component, node, count, shingles) of large groups with PIVOTS members of their group, where the sets are similar enough."""
    lot = F.xxhash64("node", F.lit("pivot"))
    chosen = members.groupBy("component", F.pmod(lot, F.lit(PIVOTS)).alias("j")).agg(F.min(F.struct(lot.alias("h"), "node")).alias("p"), F.first("count").alias("count"))
    pivots = chosen.select(F.col("p.node").alias("pivot"), F.ceil(F.col("count") / SALT).cast("int").alias("salts")).join(members.select("component", F.col("node").alias("pivot"), F.col("shingles").alias("other")), "pivot")
    pivots = pivots.select("component", "pivot", "other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    salted = members.withColumn("salt", F.pmod(F.xxhash64("node", F.lit("salt")), F.ceil(F.col("count") / SALT)).cast("int"))
    n, m = F.size("shingles"), F.size("other")
    shared = F.size(F.array_intersect("shingles", "other"))
    alike = (F.least(n, m) + 1e-9 >= similarity * F.greatest(n, m)) & (shared + 1e-9 >= similarity * (n + m - shared))
    return salted.join(pivots, ["component", "salt"]).filter((F.col("node") != F.col("pivot")) & alike).select(F.col("node").alias("a"), F.col("pivot").alias("b"))


def checked_links(groups: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Candidate groups (node, component) -> links (a, b) with the components of the pairs whose shingle sets are similar enough.

    The largest component that the pivots of a large group make is settled; each other member, the rest, is compared with
    all.  Both are cut into blocks, and a block of the rest with a block of all is a unit of work of bounded size.
    """
    size = groups.groupBy("component").count()
    members = checkpoint(join_split(groups, size, ["component"]).join(sets, F.col("node") == F.col("id")).select("component", "node", "count", "shingles"))
    large = F.col("count") > BLOCK
    of_small = members.filter(~large).select("node", "component", F.col("node").alias("label"), F.lit(True).alias("rest"), *(F.lit(0).alias(c) for c in ("own", "mine", "block", "part")), "shingles")
    if size.filter(large).isEmpty():
        return unit_links(of_small, similarity)
    found = checkpoint(pivot_links(members.filter(large), similarity))
    label = components(found)
    labelled = checkpoint(members.filter(large).select("component", "node").join(label.withColumnRenamed("component", "label"), "node", "left").select("component", "node", F.coalesce("label", "node").alias("label")))
    parts = labelled.groupBy("component", "label").count()
    most = parts.groupBy("component").agg(F.max(F.struct("count", "label")).alias("most"), F.sum("count").alias("all"))
    most = most.select("component", F.col("most.label").alias("most"), F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("all") - F.col("most.count")) / BLOCK).cast("int").alias("rests"))
    dealt = join_split(labelled, most, ["component"]).filter("rests > 0").withColumn("rest", F.col("label") != F.col("most"))
    of_large = dealt.select("node", "component", "label", "rest", "blocks", "rests", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own"), F.pmod(F.xxhash64("node", F.lit("rest")), F.col("rests")).cast("int").alias("mine"))
    down = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda r: F.struct(F.col("own").alias("block"), r.alias("part")))
    across = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), F.col("mine").alias("part")))
    places = F.inline(F.when(F.col("rest"), F.array_union(down, across)).otherwise(down))
    units = of_large.select("node", "component", "label", "rest", "own", "mine", places).join(members.filter(large).select("node", "shingles"), "node")
    return found.union(unit_links(units.unionByName(of_small), similarity))


def unit_links(rows: DataFrame, similarity: float) -> DataFrame:
    """Units of work (component, block, part) -> links (a, b) with the components of their similar pairs."""

    def similar(x: np.ndarray, y: np.ndarray) -> bool:
        shared = len(np.intersect1d(x, y, assume_unique=True))
        return shared + 1e-9 >= similarity * (len(x) + len(y) - shared)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _in_groups(batches, ["component", "block", "part"], 1 << 11):
            node, label, rest = (group[c].to_numpy() for c in ("node", "label", "rest"))
            own, mine, block, part = (group[c].to_numpy() for c in ("own", "mine", "block", "part"))
            shingles = group["shingles"].to_list()
            w = _Parities([parities(x.view(np.uint32)) for x in shingles])
            n = np.array([len(x) for x in shingles], np.int64)
            first = _starts(group["component"].to_numpy(), block, part)
            links = _Links(len(group))
            for lo, hi in zip(first.tolist(), np.append(first[1:], len(group)).tolist()):
                loose, here = lo + np.flatnonzero(rest[lo:hi] & (mine[lo:hi] == part[lo])), lo + np.flatnonzero(own[lo:hi] == block[lo])
                a, b = np.repeat(loose, len(here)), np.tile(here, len(loose))
                apart = (label[a] != label[b]) & (~rest[b] | (node[a] < node[b]))
                a, b, bits = _within(w, n, a[apart], b[apart], similarity)
                order = np.argsort(bits, kind="stable")
                a, b = a[order], b[order]
                for at in range(0, len(a), 256):  # the closest first; what they link needs no check any more
                    x, y = a[at : at + 256], b[at : at + 256]
                    apart = np.flatnonzero(links.label[x] != links.label[y])
                    good = [k for k in apart.tolist() if similar(shingles[x[k]], shingles[y[k]])]
                    links.join(x[good], y[good])
            yield _star(links.label, node.astype(np.int64))

    dealt = rows.repartition(partitions(rows.sparkSession), "component", "block", "part").sortWithinPartitions("component", "block", "part")
    return dealt.mapInPandas(run, "a long, b long")


def of_ids(docs: DataFrame, ids: DataFrame, id_col: str, how: str) -> DataFrame:
    """Semi or anti join of ``docs`` with a table of distinct ids, broadcast only if they are few."""
    few = ids.count() <= BROADCAST_IDS
    ids = ids.withColumnRenamed(ids.columns[0], "__u_id")
    return docs.join(F.broadcast(ids) if few else ids, F.col(id_col) == F.col("__u_id"), how)


def shingle_sets(docs: DataFrame, *, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, shingles array<int>): the distinct shingles by the low 32 bits of their hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, words).astype(np.uint32)).view(np.int32) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "shingles": sets})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, shingles array<int>")


def near_duplicates(docs: DataFrame, *, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component long): groups of documents linked by a similarity of their word shingles of at least ``similarity``.

    Texts with the same words always share a group.
    """
    ids = docs.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.count("*").alias("n"))
    n, repeated = ids.agg(F.sum("n"), F.max(F.when(F.col("id").isNotNull(), F.col("n")))).first()
    common = common_shingles(docs, words=words, text_col=text_col, n=n or 0)
    prints = checkpoint(set_prints(docs, common, similarity, words=words, id_col=id_col, text_col=text_col))
    reps = checkpoint(prints.groupBy("x0", "x1").agg(F.min("id").alias("rep"), *(F.first(c).alias(c) for c in ("fingerprint", "n", "w"))))
    known = reps.filter("rep IS NOT NULL")
    close = checkpoint(hamming_links(known.select("rep", "fingerprint")))
    # the smallest neighbour stands for what is linked already; that saves comparisons, no more
    label = close.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    label = label.unionByName(close.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()).groupBy("node").agg(F.min("component").alias("component"))
    own = join_split(prints.filter("id IS NOT NULL"), known.select("x0", "x1", "rep"), ["x0", "x1"])
    if (repeated or 0) > 1:
        lists = own.filter("id = rep").dropDuplicates(["x0", "x1"]).select("rep", "rare", "prefix")
    else:
        copies = checkpoint(own.filter("id <> rep").select("id"))
        lists = of_ids(prints.filter("id IS NOT NULL").select(F.col("id").alias("rep"), "rare", "prefix"), copies, "rep", "left_anti")
    rare = lists.select("rep", F.explode(F.slice("prefix", 1, F.col("rare"))).alias("token"))
    often = lists.select("rep", F.explode(F.slice("prefix", F.col("rare") + 1, F.size("prefix"))).alias("token"))
    tokens = checkpoint(shared_tokens(rare).union(often.select("token", "rep")))
    light = known.join(label, F.col("rep") == F.col("node"), "left").select("rep", "n", F.coalesce("component", "rep").alias("label"), "w")
    rows = tokens.join(light, "rep")
    big = checkpoint(tokens.groupBy("token").count().filter(F.col("count") > LIST))
    near = checkpoint(list_links(rows.join(told(big), "token", "left_anti"), similarity).union(close))
    if not big.isEmpty():
        near = checkpoint(split_links(rows, big, near, similarity))
    groups = checkpoint(components(near))
    sets = shingle_sets(of_ids(docs, groups.select("node"), id_col, "left_semi"), words=words, id_col=id_col, text_col=text_col)
    found = components(checkpoint(checked_links(groups, sets.dropDuplicates(["id"]) if (repeated or 0) > 1 else sets, similarity)))
    labels = reps.join(found, reps["rep"] == found["node"], "left").select("x0", "x1", F.coalesce("component", "rep").alias("component"))
    return join_split(prints.select("id", "x0", "x1"), labels, ["x0", "x1"]).select("id", "component")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with the smallest id of each group of near duplicates; rows without an id stay."""
    groups = near_duplicates(docs, id_col=id_col, **options)
    others = checkpoint(groups.filter("id <> component").select("id").distinct())
    return of_ids(docs, others, id_col, "left_anti")


def keep_one_row(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, that with the smallest id; also where ids repeat or are null.

    Such rows get a key of their own, which is stored with them, so that it stays the same.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("id")).groupBy("id").count()
    if ids.filter("id IS NULL OR count > 1").isEmpty():
        return drop_near_duplicates(docs, id_col=id_col, **options)
    keyed = checkpoint(docs.withColumn("__u_row", F.monotonically_increasing_id()))
    groups = near_duplicates(keyed, id_col="__u_row", **options)
    rank = F.struct(F.col(id_col).cast("long").isNull().alias("none"), F.col(id_col).cast("long").alias("id"), F.col("__u_row").alias("row"))
    rows = checkpoint(groups.join(keyed.select(F.col("__u_row").alias("id"), rank.alias("rank")), "id"))
    best = rows.groupBy("component").agg(F.min("rank").alias("best"))
    others = checkpoint(rows.join(best, "component").filter("id <> best.row").select("id"))
    return of_ids(keyed, others, "__u_row", "left_anti").drop("__u_row")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    from undula.llm.common import read

    found = simhash_groups(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
