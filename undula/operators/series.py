"""Long series as chunks: other rates, whole transforms, whole correlations and recursive filters.

A series is a table of chunks (file, ch, chunk, x array<double>), all of one length
but the last, or of pieces (file, ch, first, x) that start at sample ``first``.
Every step works on chunks or on blocks of bounded size; what has to pass from one
to the next goes through a shuffle on (file, ch, place), never through one task.

Defined results: chunks are numbered from 0 without gaps; samples beyond the ends
of a series, and null samples, count as zero; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.operators.batches import DOUBLES, by_slices
from undula.operators.events import running_sum
from undula.operators.sized import small

KEYS = ["file", "ch"]


def _array(v) -> np.ndarray:
    return np.nan_to_num(np.asarray(v, np.float64)) if v is not None else np.zeros(0)


# -- chunks --------------------------------------------------------------------


def chunked(samples: DataFrame, size: int, *, order: str = "pos") -> DataFrame:
    """Chunks of ``size`` of samples (file, ch, order, x) numbered from 0."""
    rows = samples.groupBy(*KEYS, F.floor(F.col(order) / size).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("p"), F.col("x").cast("double").alias("x")))).alias("s"))
    return rows.select(*KEYS, "chunk", F.transform("s", lambda s: F.coalesce(s["x"], F.lit(0.0))).alias("x"))


def as_pieces(chunks: DataFrame, size: int) -> DataFrame:
    return chunks.select(*KEYS, (F.col("chunk") * size).cast("long").alias("first"), F.col("x").cast("array<double>").alias("x"))


def rechunked(pieces: DataFrame, size: int, *, with_first: bool = False) -> DataFrame:
    """Chunks of ``size`` of pieces of any lengths: each piece is cut at the borders, and each chunk put together from its cuts.

    Pieces may start anywhere; ``with_first`` adds the sample that a chunk begins with.
    """
    end = F.col("first") + F.size("x")
    cuts = pieces.filter(F.size("x") > 0).withColumn("chunk", F.explode(F.sequence(F.floor(F.col("first") / size), F.floor((end - 1) / size))))
    start = F.greatest(F.col("first"), F.col("chunk") * size)
    length = F.least(end, (F.col("chunk") + 1) * size) - start
    cut = cuts.select(*KEYS, "chunk", F.struct(start.alias("p"), F.slice("x", (start - F.col("first") + 1).cast("int"), length.cast("int")).alias("x")).alias("s"))
    put = cut.groupBy(*KEYS, "chunk").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return put.select(*KEYS, "chunk", *([F.get("s", F.lit(0))["p"].alias("first")] if with_first else []), F.flatten(F.transform("s", lambda s: s["x"])).alias("x"))


def with_margins(chunks: DataFrame, before: int, after: int) -> DataFrame:
    """Adds ``left``, the last ``before`` samples of the chunk before, and ``right``, the first ``after`` of the next: one shuffle."""
    x, none = F.col("x").cast("array<double>"), F.lit(None).cast("array<double>")
    row = lambda at, own, left, right: F.struct(at.cast("long").alias("chunk"), own.alias("x"), left.alias("left"), right.alias("right"))
    tail = F.slice(x, F.greatest(F.size("x") - before + 1, F.lit(1)), before) if before else F.array().cast("array<double>")
    head = F.slice(x, 1, after) if after else F.array().cast("array<double>")
    sent = chunks.select(*KEYS, F.explode(F.array(row(F.col("chunk"), x, none, none), row(F.col("chunk") + 1, none, tail, none), row(F.col("chunk") - 1, none, none, head))).alias("r")).select(*KEYS, "r.*")
    empty = F.array().cast("array<double>")
    # Each of the three comes once, so the largest is the one there is.
    met = sent.groupBy(*KEYS, "chunk").agg(F.max("x").alias("x"), F.coalesce(F.max("left"), empty).alias("left"), F.coalesce(F.max("right"), empty).alias("right"))
    return met.filter(F.col("x").isNotNull())


# -- rational rates --------------------------------------------------------------


def resampling_taps(up: int, down: int, half: int) -> np.ndarray:
    """(phase, tap): a Hann-windowed sinc at ``up`` times the rate; tap t of phase p is at p - (t - reach) * up."""
    wide = max(up, down)
    reach = -(-half * wide // up)
    n = np.arange(up)[:, None] - np.arange(-reach, reach + 1)[None, :] * up
    edge = half * wide
    return np.where(np.abs(n) < edge, min(1.0, up / down) * np.sinc(n / wide) * (0.5 + 0.5 * np.cos(np.pi * n / edge)), 0.0)


def resampled(chunks: DataFrame, up: int, down: int, chunk: int, *, half: int = 8) -> DataFrame:
    """Pieces at ``up`` / ``down`` times the rate: sample m is taken at m * down / up of the old samples.

    A chunk makes the samples that lie in it; their phases follow from the chunk's number alone, so results do not depend on ``chunk``.
    A filter reaches ``half`` zero crossings to each side, and has to fit a chunk.
    """
    if up < 1 or down < 1:
        raise ValueError("rates have to be positive")
    common = math.gcd(up, down)
    up, down = up // common, down // common
    taps = resampling_taps(up, down, half)
    reach = taps.shape[1] // 2
    if reach > chunk:
        raise ValueError("the filter does not fit a chunk")

    def samples(at: pd.Series, left: pd.Series, x: pd.Series, right: pd.Series) -> list[np.ndarray]:
        out = []
        for k, a, v, b in zip(at, left, x, right):
            a, v, b = _array(a), _array(v), _array(b)
            start = int(k) * chunk
            padded = np.concatenate([np.zeros(reach - len(a)), a, v, b, np.zeros(reach - len(b))])
            m = np.arange(-(-start * up // down), -(-(start + len(v)) * up // down))
            place, phase = np.divmod(m * down, up)
            out.append((padded[(place - start)[:, None] + np.arange(2 * reach + 1)] * taps[phase]).sum(1))
        return out

    filtered = by_slices(samples, "array<double>", DOUBLES)
    first = F.expr(f"(cast(chunk AS long) * {chunk * up}L + {down - 1}) div {down}")
    return with_margins(chunks, reach, reach).select(*KEYS, first.alias("first"), filtered("chunk", "left", "x", "right").alias("x"))


def to_rate(chunks: DataFrame, rate: int, wanted: int, chunk: int) -> DataFrame:
    """The chunks of a series at another rate, again of ``chunk`` samples."""
    return chunks if rate == wanted else rechunked(resampled(chunks, wanted, rate, chunk), chunk)


# -- whole transforms --------------------------------------------------------------

CUT = "file {file}, ch {ch}, n1 long, of long, to long, re array<double>, im array<double>"
#: Rows of a matrix that are sent as one.
SPAN = 256
#: How many numbers a task holds.
CELLS = 1 << 18

SPECTRUM = "file {file}, ch {ch}, n1 long, row long, re array<double>, im array<double>"


def _types(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def _sent(df: DataFrame, width: int, block: int) -> DataFrame:
    """Rows cut in blocks of columns, each to its own key ``to``: the transpose of a matrix that no task holds.

    Rows go together by spans, so that a group has a row for each span and not for each row of a long series.  Without ``im`` it is zero.
    """
    met = df.groupBy(*KEYS, "n1", F.floor(F.col("row") / SPAN).alias("span")).agg(F.array_sort(F.collect_list(F.struct("row", *(c for c in ("re", "im") if c in df.columns)))).alias("s"))
    met = met.withColumn("at", F.transform("s", lambda r: (r["row"] - F.col("span") * SPAN).cast("int")))

    def part(name: str, b: Column) -> Column:
        cut = F.flatten(F.transform("s", lambda r: F.slice(r[name], b * block + 1, block))) if name in df.columns else F.lit(None).cast("array<double>")
        return cut.alias(name)

    cut = F.transform(F.sequence(F.lit(0), F.lit((width - 1) // block)), lambda b: F.struct(b.cast("long").alias("to"), part("re", b), part("im", b)))
    return met.select(*KEYS, "n1", "span", "at", F.explode(cut).alias("c")).select(*KEYS, "n1", "span", "at", "c.*")


def _matrix(rows: pd.DataFrame, height: int) -> np.ndarray:
    out = np.zeros((height, len(rows["re"].iloc[0]) // len(rows["at"].iloc[0])), complex)
    for span, at, re, im in zip(rows["span"], rows["at"], rows["re"], rows["im"]):
        k = int(span) * SPAN + np.asarray(at)
        out.real[k] = _array(re).reshape(len(k), -1)
        if im is not None:
            out.imag[k] = _array(im).reshape(len(k), -1)
    return out


def _columns(n2: int, block: int, rows_each: int, *, inverse: bool):
    """Transforms of columns: a group has all rows of a block of columns.  What goes to one block of rows leaves as one row."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        n1, to = int(rows["n1"].iloc[0]), int(rows["to"].iloc[0])
        m = _matrix(rows, n1)
        column, k1 = to * block + np.arange(m.shape[1]), np.arange(n1)
        # The exponent is reduced as a whole number, so that twiddles stay exact for long series.
        turn = np.exp((2j if inverse else -2j) * np.pi * ((column[None, :] * k1[:, None]) % (n1 * n2)) / (n1 * n2))
        m = np.fft.ifft(m * turn, axis=0) if inverse else np.fft.fft(m, axis=0) * turn
        out = []
        for at in range(0, n1, rows_each):
            part = m[at : at + rows_each]
            out.append((rows["file"].iloc[0], rows["ch"].iloc[0], n1, to, at // rows_each, part.real.ravel(), part.imag.ravel()))
        return pd.DataFrame(out, columns=["file", "ch", "n1", "of", "to", "re", "im"])

    return run


def _rows(n2: int, block: int, rows_each: int, *, transform):
    """A group has all columns of a block of rows: ``transform`` (matrix) along each row."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        n1, to = int(rows["n1"].iloc[0]), int(rows["to"].iloc[0])
        height = min(rows_each, n1 - to * rows_each)
        m = np.zeros((height, n2), complex)
        for of, re, im in zip(rows["of"], rows["re"], rows["im"]):
            part = (np.asarray(re) + 1j * np.asarray(im)).reshape(height, -1)
            m[:, int(of) * block : int(of) * block + part.shape[1]] = part
        m = transform(m)
        return pd.DataFrame({"file": rows["file"].iloc[0], "ch": rows["ch"].iloc[0], "n1": n1, "row": to * rows_each + np.arange(height), "re": list(m.real), "im": list(m.imag)})

    return run


def columns_each(chunks: DataFrame, chunk: int, cells: int = CELLS) -> int:
    """How many columns a task takes so that it holds about ``cells`` numbers of the longest series, at least one column."""
    longest = chunks.agg(F.max("chunk").alias("n")).first()["n"] or 0
    return max(1, min(chunk, cells // (longest + 1)))


def whole_spectrum(chunks: DataFrame, chunk: int, *, block: int, cells: int = CELLS) -> DataFrame:
    """The Fourier transform of each whole series, padded by zeros to whole chunks: (file, ch, n1, row, re, im), n1 chunks of n2 = ``chunk`` samples.

    Row r holds the bins r, r + n1, r + 2 * n1, ...  Four steps: transforms down the columns of the matrix of chunks, twiddles,
    a transpose, transforms along its rows; two shuffles.  A task holds ``block`` columns, or about ``cells`` numbers of rows.
    """
    types, r = _types(chunks), max(1, cells // chunk)
    n1 = chunks.groupBy(*KEYS).agg((F.max("chunk") + 1).cast("long").alias("n1"))
    rows = chunks.join(small(n1), KEYS).select(*KEYS, "n1", F.col("chunk").alias("row"), F.col("x").cast("array<double>").alias("re"))
    padded = F.concat("re", F.array_repeat(F.lit(0.0), F.lit(chunk) - F.size("re")))
    rows = rows.withColumn("re", F.transform(padded, lambda v: F.coalesce(v, F.lit(0.0))))
    turned = _sent(rows, chunk, block).groupBy(*KEYS, "to").applyInPandas(_columns(chunk, block, r, inverse=False), CUT.format(**types))
    return turned.groupBy(*KEYS, "to").applyInPandas(_rows(chunk, block, r, transform=lambda m: np.fft.fft(m, axis=1)), SPECTRUM.format(**types))


def whole_series(spectrum: DataFrame, chunk: int, *, block: int, cells: int = CELLS) -> DataFrame:
    """The inverse of ``whole_spectrum``: chunks (file, ch, chunk, re, im) in order of time, by the same steps backwards."""
    types, r = _types(spectrum), max(1, cells // chunk)

    def inverse(re: pd.Series, im: pd.Series) -> list[dict]:
        m = [np.fft.ifft(np.asarray(a) + 1j * np.asarray(c)) for a, c in zip(re, im)]
        return [{"re": v.real, "im": v.imag} for v in m]

    along = by_slices(inverse, "struct<re: array<double>, im: array<double>>", pa.struct([("re", DOUBLES), ("im", DOUBLES)]))
    rows = spectrum.select(*KEYS, "n1", "row", along("re", "im").alias("v")).select(*KEYS, "n1", "row", "v.*")
    turned = _sent(rows, chunk, block).groupBy(*KEYS, "to").applyInPandas(_columns(chunk, block, r, inverse=True), CUT.format(**types))
    back = turned.groupBy(*KEYS, "to").applyInPandas(_rows(chunk, block, r, transform=lambda m: m), SPECTRUM.format(**types))
    return back.select(*KEYS, F.col("row").alias("chunk"), "re", "im")


def bins_of_spectrum(spectrum: DataFrame) -> DataFrame:
    """(file, ch, bin, re, im) of a whole spectrum."""
    pairs = spectrum.select(*KEYS, "n1", "row", F.posexplode(F.arrays_zip("re", "im")).alias("k", "v"))
    return pairs.select(*KEYS, (F.col("row") + F.col("n1") * F.col("k")).alias("bin"), "v.re", "v.im")


def weighted_bins(spectrum: DataFrame, chunk: int, weight) -> DataFrame:
    """Each bin times ``weight(f)``, f being its signed frequency in cycles a sample, from -1/2 to 1/2."""
    n = F.col("n1") * chunk

    def scaled(name: str) -> Column:
        def one(v: Column, k: Column) -> Column:
            place = F.col("row") + F.col("n1") * k
            return v * weight(F.when(place * 2 > n, place - n).otherwise(place) / n)

        return F.transform(name, one).alias(name)

    return spectrum.select(*KEYS, "n1", "row", scaled("re"), scaled("im"))


def band_passed(chunks: DataFrame, chunk: int, low: float, high: float, *, cells: int = CELLS) -> DataFrame:
    """Chunks of the part of each series between two frequencies (cycles a sample, both inclusive), without delay; padded to whole chunks."""
    block = columns_each(chunks, chunk, cells)
    spectrum = weighted_bins(whole_spectrum(chunks, chunk, block=block, cells=cells), chunk, lambda f: F.when(F.abs(f).between(low, high), 1.0).otherwise(0.0))
    return whole_series(spectrum, chunk, block=block, cells=cells).select(*KEYS, "chunk", F.col("re").alias("x"))


def analytic(chunks: DataFrame, chunk: int, low: float = 0.0, high: float = 0.5, *, cells: int = CELLS) -> DataFrame:
    """Chunks (re, im) of the analytic signal of each series within a band: positive frequencies twice, negative ones not at all."""
    twice = lambda f: F.when((f == 0) | (f == 0.5), 1.0).when(f > 0, 2.0).otherwise(0.0)
    block = columns_each(chunks, chunk, cells)
    spectrum = weighted_bins(whole_spectrum(chunks, chunk, block=block, cells=cells), chunk, lambda f: F.when(F.abs(f).between(low, high), twice(f)).otherwise(0.0))
    return whole_series(spectrum, chunk, block=block, cells=cells)


def unwrapped_phase(signal: DataFrame) -> DataFrame:
    """(file, ch, chunk, x): the phase of chunks (re, im) without jumps, from its first value on.

    Steps between neighbours are wrapped to half a turn and added up within a chunk; whole chunks are added up by their totals, and those by
    spans of chunks, so that no task has a whole series.
    """
    angle = F.transform(F.arrays_zip("re", "im"), lambda v: F.atan2(v["im"], v["re"]))
    phases = signal.select(*KEYS, "chunk", angle.alias("x"))

    def phase_sums(left: pd.Series, x: pd.Series) -> list[np.ndarray]:
        out = []
        for a, v in zip(left, x):
            v = np.asarray(v, np.float64)
            steps = np.diff(v, prepend=np.asarray(a, np.float64)) if len(a) else np.diff(v, prepend=0.0)
            steps -= 2 * np.pi * np.floor((steps + np.pi) / (2 * np.pi))
            if not len(a) and len(v):
                steps[0] = v[0]  # the first step of a series is its first phase
            out.append(np.cumsum(steps))
        return out

    added = by_slices(phase_sums, "array<double>", DOUBLES)
    summed = with_margins(phases, 1, 0).select(*KEYS, "chunk", added("left", "x").alias("x"))
    totals = summed.select(F.struct(*KEYS).alias("_key"), "chunk", F.element_at("x", -1).alias("_total"))
    before_ = running_sum(totals, F.col("_total"), "_sum", file="_key", order="chunk").select("_key.*", "chunk", (F.col("_sum") - F.col("_total")).alias("_base"))
    return summed.join(before_, [*KEYS, "chunk"]).select(*KEYS, "chunk", F.transform("x", lambda v: v + F.col("_base")).alias("x"))


# -- whole correlations --------------------------------------------------------------


def section_correlations(a: DataFrame, b: DataFrame, chunk: int, most: int, *, section: int = 1 << 16) -> DataFrame:
    """(file, ch, lag, product): sums of a[p + lag] * b[p] over the whole series of equal (file, ch), for lags up to ``most`` to both sides.

    Series are cut in sections; a section of ``b`` meets those of ``a`` that a lag can reach, by an equi-join on the section.  Each
    pair is correlated by a transform of twice the section, pairs of one difference of sections are added up in the task, and lags
    of neighbouring differences overlap and are added by Spark.
    """
    reach = -(-most // section)
    x, y = rechunked(as_pieces(a, chunk), section), rechunked(as_pieces(b, chunk), section)
    asked = y.select(*KEYS, F.col("chunk").alias("_at"), F.col("x").alias("y"), F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("step"))
    met = x.join(asked.withColumn("chunk", F.col("_at") + F.col("step")), [*KEYS, "chunk"]).select(*KEYS, "step", "x", "y")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def given() -> pd.DataFrame:
            out = pd.DataFrame([(*key, v) for key, v in held.items()], columns=["file", "ch", "step", "v"])
            held.clear()
            return out

        for batch in batches:
            for file, ch, step, u, v in zip(batch["file"], batch["ch"], batch["step"], batch["x"], batch["y"]):
                f = np.fft.rfft(_array(u), 2 * section) * np.conj(np.fft.rfft(_array(v), 2 * section))
                part = np.fft.irfft(f, 2 * section)
                if (file, ch, step) in held:
                    held[file, ch, step] += part
                else:
                    held[file, ch, step] = part
                if len(held) * section > 1 << 22:
                    yield given()
        if held:
            yield given()

    types = _types(a)
    sums = met.mapInPandas(run, f"file {types['file']}, ch {types['ch']}, step int, v array<double>")
    # Place k of a pair is lag k, or k - 2 * section in the upper half.
    lags = sums.select(*KEYS, "step", F.posexplode("v").alias("k", "product"))
    lag = F.col("step") * section + F.when(F.col("k") < section, F.col("k")).otherwise(F.col("k") - 2 * section)
    return lags.select(*KEYS, lag.cast("long").alias("lag"), "product").filter(F.abs("lag") <= most).groupBy(*KEYS, "lag").agg(F.sum("product").alias("product"))


def mean_free(chunks: DataFrame) -> DataFrame:
    """Chunks less the mean of their series."""
    total = F.aggregate(F.col("x").cast("array<double>"), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    means = chunks.groupBy(*KEYS).agg((F.sum(total) / F.sum(F.size("x"))).alias("_mean"))
    return chunks.join(small(means), KEYS).select(*KEYS, "chunk", F.transform(F.col("x").cast("array<double>"), lambda v: F.coalesce(v, F.lit(0.0)) - F.col("_mean")).alias("x"))


def strongest_lags(a: DataFrame, b: DataFrame, chunk: int, most: int, *, section: int = 1 << 16) -> DataFrame:
    """(file, ch, lag, product): where the correlation of the mean-free series is strongest, of equals the least lag."""
    products = section_correlations(mean_free(a), mean_free(b), chunk, most, section=section)
    best = products.groupBy(*KEYS).agg(F.min(F.struct((-F.abs("product")).alias("s"), "lag", "product")).alias("m"))
    return best.select(*KEYS, "m.lag", "m.product")


# -- recursive filters ------------------------------------------------------------------

Section = tuple[float, float, float, float, float]


def state_space(sections: list[Section]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """A, B, C, D of a cascade of second-order sections (b0, b1, b2, a1, a2): s' = A s + B x, y = C s + D x."""
    a, b, c, d = np.zeros((0, 0)), np.zeros(0), np.zeros(0), 1.0
    for b0, b1, b2, a1, a2 in sections:
        own, into, out = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0]), np.array([1.0, 0.0])
        n = len(b)
        whole = np.zeros((n + 2, n + 2))
        whole[:n, :n], whole[n:, n:], whole[n:, :n] = a, own, np.outer(into, c)
        a, b, c, d = whole, np.concatenate([b, into * d]), np.concatenate([b0 * c, out]), b0 * d
    return a, b, c, d


def _powers(a: np.ndarray, n: int) -> np.ndarray:
    out = [np.eye(len(a))]
    for _ in range(n):
        out.append(out[-1] @ a)
    return np.array(out)


def _run_filter(rows: list[np.ndarray], starts: np.ndarray, space, *, step: int = 64) -> tuple[list[np.ndarray], np.ndarray]:
    """Filters rows that start in states ``starts``: (outputs, states at their ends).  All rows go forward together, ``step`` samples of every piece at a time."""
    a, b, c, d = space
    power = _powers(a, step)
    longest = -(-max(map(len, rows), default=0) // step) * step
    x = np.zeros((len(rows), longest))
    for k, v in enumerate(rows):
        x[k, : len(v)] = v
    pieces = x.reshape(len(rows), -1, step)
    s = np.zeros((*pieces.shape[:2], len(b)))
    y = np.empty_like(pieces)
    for t in range(step):
        y[..., t] = s @ c + d * pieces[..., t]
        s = s @ a.T + pieces[..., t, None] * b
    free = np.einsum("d,tde->te", c, power[:-1])  # what a state adds to the outputs of its piece
    state, ends = starts.copy(), np.empty_like(starts)
    sizes = np.array([len(v) for v in rows])
    for p in range(pieces.shape[1]):
        y[:, p] += state @ free.T
        rest = sizes - p * step
        for k in np.flatnonzero((rest > 0) & (rest < step)):  # a row that ends within the piece
            left = state[k]
            for v in pieces[k, p, : rest[k]]:
                left = a @ left + b * v
            ends[k] = left
        state = np.where((rest >= step)[:, None], state @ power[-1].T + s[:, p], state)
        ends[rest == step] = state[rest == step]
    ends[sizes == 0] = starts[sizes == 0]
    y = y.reshape(len(rows), -1)
    return [y[k, :n] for k, n in enumerate(sizes)], ends


def carried_states(ends: DataFrame, a_chunk: np.ndarray, *, span: int = 4096) -> DataFrame:
    """(file, ch, chunk, start): the state each chunk starts in, from (file, ch, chunk, v), what it ends in if it starts at zero.

    A chunk maps its first state s to a_chunk s + v.  Such maps are joined in any grouping: within spans of chunks first, then
    spans of spans, until a series is one span; so a task has ``span`` rows however long the series is.
    """
    dim = len(a_chunk)
    types = _types(ends)
    schema = f"file {types['file']}, ch {types['ch']}, chunk long, start array<double>, total array<double>"

    def within(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        s, out, last = np.zeros(dim), [], len(rows) - 1
        for k, (c, v) in enumerate(zip(rows["chunk"], rows["v"])):
            start, s = s, a_chunk @ s + np.asarray(v)
            out.append((rows["file"].iloc[0], rows["ch"].iloc[0], c, start, s if k == last else None))
        return pd.DataFrame(out, columns=["file", "ch", "chunk", "start", "total"])

    scanned = ends.groupBy(*KEYS, F.floor(F.col("chunk") / span).alias("_span")).applyInPandas(within, schema)
    last = ends.agg(F.max("chunk").alias("n")).first()["n"]
    if last is None or last < span:
        return scanned.drop("total")
    by_span = np.linalg.matrix_power(a_chunk, span)
    totals = scanned.filter(F.col("total").isNotNull()).select(*KEYS, F.floor(F.col("chunk") / span).alias("chunk"), F.col("total").alias("v"))
    above = carried_states(totals, by_span, span=span).select(*KEYS, F.col("chunk").alias("_span"), F.col("start").alias("_above"))
    power = _powers(a_chunk, span)

    @F.pandas_udf("array<double>")
    def joined(start: pd.Series, chunk: pd.Series, above_: pd.Series) -> pd.Series:
        at = chunk.to_numpy(np.int64) % span
        moved = np.einsum("nij,nj->ni", power[at], np.stack(above_.to_list())) if len(at) else np.zeros((0, dim))
        return pd.Series([np.asarray(s) + m for s, m in zip(start, moved)])

    spread = scanned.withColumn("_span", F.floor(F.col("chunk") / span)).join(above, [*KEYS, "_span"])
    return spread.select(*KEYS, "chunk", joined("start", "chunk", "_above").alias("start"))


def recursive_filter(chunks: DataFrame, sections: list[Section], chunk: int, *, span: int = 4096) -> DataFrame:
    """Chunks of each series through a cascade of second-order sections, in order of time from a state of zero.

    Chunks are filtered from zero at once, the states they end in are carried along the series, and chunks are filtered
    again from the states they start in.
    """
    space = state_space(sections)
    dim = len(space[1])

    # Chunks go forward together, a few at a time.
    ends = by_slices(lambda x: list(_run_filter([_array(v) for v in x], np.zeros((len(x), dim)), space)[1]), "array<double>", DOUBLES, rows=64)
    filtered = by_slices(lambda x, start: _run_filter([_array(v) for v in x], np.stack(start.to_list()), space)[0], "array<double>", DOUBLES, rows=64)

    states = carried_states(chunks.select(*KEYS, F.col("chunk").cast("long").alias("chunk"), ends("x").alias("v")), np.linalg.matrix_power(space[0], chunk), span=span)
    return chunks.join(states, [*KEYS, "chunk"]).select(*KEYS, "chunk", filtered("x", "start").alias("x"))


def k_weighting_sections(rate: float) -> list[Section]:
    """The two sections that weight sound by loudness, at any rate: a high shelf and a high pass, mapped from their analogue forms."""
    # Fixed values of the published analogue forms: frequency in Hz and quality of each, gain in dB of the shelf.
    shelf_hz, shelf_q, shelf_db, pass_hz, pass_q = 1681.974450955533, 0.7071752369554196, 3.999843853973347, 38.13547087602444, 0.5003270373238773
    k = math.tan(math.pi * shelf_hz / rate)
    high, band = 10 ** (shelf_db / 20), 10 ** (shelf_db / 20 * 0.4996667741545416)
    norm = 1 + k / shelf_q + k * k
    shelf = ((high + band * k / shelf_q + k * k) / norm, 2 * (k * k - high) / norm, (high - band * k / shelf_q + k * k) / norm, 2 * (k * k - 1) / norm, (1 - k / shelf_q + k * k) / norm)
    k = math.tan(math.pi * pass_hz / rate)
    norm = 1 + k / pass_q + k * k
    return [shelf, (1.0, -2.0, 1.0, 2 * (k * k - 1) / norm, (1 - k / pass_q + k * k) / norm)]


def short_powers(chunks: DataFrame, rate: int, chunk: int, *, step: float = 0.1, steps: int = 4) -> DataFrame:
    """(file, frame, p): mean power over windows of ``steps`` steps of ``step`` seconds, one a step, summed over channels; the rest of the end is left out."""
    hop = round(rate * step)

    @F.pandas_udf("array<double>")
    def powers(at: pd.Series, x: pd.Series) -> pd.Series:
        out = []
        for k, v in zip(at, x):
            v = _array(v) ** 2
            first = int(k) * chunk // hop
            edges = np.arange(first, (int(k) * chunk + max(len(v), 1) - 1) // hop + 1) * hop - int(k) * chunk
            out.append(np.add.reduceat(v, np.maximum(edges, 0)) if len(v) else np.zeros(0))
        return pd.Series(out)

    parts = chunks.select(*KEYS, F.floor(F.col("chunk") * chunk / F.lit(hop)).alias("_f"), F.posexplode(powers("chunk", "x")).alias("_k", "p"), "chunk", F.size("x").alias("_n"))
    by_step = parts.groupBy(*KEYS, (F.col("_f") + F.col("_k")).alias("step")).agg(F.sum("p").alias("p"))
    whole = chunks.groupBy(*KEYS).agg(F.sum(F.size("x")).alias("_n"))
    spread = by_step.select(*KEYS, "p", F.explode(F.sequence(F.greatest(F.lit(0), F.col("step") - (steps - 1)).cast("long"), F.col("step").cast("long"))).alias("frame"))
    full = spread.join(small(whole), KEYS).filter((F.col("frame") + steps) * hop <= F.col("_n"))
    return full.groupBy("file", "frame").agg((F.sum("p") / F.lit(hop * steps)).alias("p"))
