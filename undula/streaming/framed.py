"""Frames of unbounded series: rows are held until event time has passed them, then cut with what the frame before left over."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SeriesFrames(StatefulProcessor):
    """Frames of ``size`` values every ``hop`` of each series, in order of (ts, number), whatever order its rows come in.

    State of a series: rows of open spans of time, by (span, part), where a part is what one Arrow batch brought; ``carry``, the
    frame number and the values that the next frame begins with; and the last span.  A timer at the end of each span sorts that
    span alone and cuts its frames, so no more than a span and a frame are in memory.  A timer ``gap`` after the last span ends
    the series: what is left is dropped, a series shorter than a frame gives one frame of zeros, and a later row begins a new series.
    Rows of spans that are closed already are late and are left out, as are null values and times.
    """

    def __init__(self, by: str, size: int, hop: int, span_ms: int, gap_ms: int) -> None:
        self.by, self.size, self.hop, self.span, self.gap = by, size, hop, span_ms, gap_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "span long, part long", "ts array<long>, number array<long>, value array<double>")
        self.parts = handle.getMapState("parts", "span long", "n long")
        self.carry = handle.getValueState("carry", "frame long, skip long, x array<double>")
        self.last = handle.getValueState("last", "span long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        last = self.last.get()[0] if self.last.exists() else None
        before = last
        for batch in rows:
            batch = batch[batch["value"].notna() & batch["us"].notna()]
            spans = batch["us"].astype("int64") // (self.span * 1000)
            for span, part in batch.groupby(spans):
                span = int(span)
                if (span + 1) * self.span <= passed:
                    continue
                n = self.parts.getValue((span,))[0] if self.parts.containsKey((span,)) else 0
                self.held.updateValue((span, n), (part["us"].astype("int64").tolist(), part["number"].astype("int64").tolist(), part["value"].astype(float).tolist()))
                self.parts.updateValue((span,), (n + 1,))
                if n == 0:
                    self.handle.registerTimer((span + 1) * self.span)
                last = span if last is None else max(last, span)
        if last is not None and last != before:
            self.last.update((last,))
            if before is not None:
                self.handle.deleteTimer(self._end(before))
            self.handle.registerTimer(self._end(last))
        yield from ()

    def _end(self, span: int) -> int:
        # Never the end of a span, so that the two kinds of timers differ.
        return (span + 1) * self.span + self.gap + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        frame, skip, x = self.carry.get() if self.carry.exists() else (0, 0, [])
        out = []
        for span in sorted(k[0] for k in self.parts.keys() if (k[0] + 1) * self.span <= at):
            n = self.parts.getValue((span,))[0]
            got = [self.held.getValue((span, part)) for part in range(n)]
            ts, number, value = (np.concatenate([np.asarray(g[k]) for g in got]) for k in range(3))
            x = np.concatenate([np.asarray(x, float), value[np.lexsort((number, ts))]])
            # With a hop longer than a frame, some values belong to no frame.
            gone = min(skip, len(x))
            x, skip = x[gone:], skip - gone
            for part in range(n):
                self.held.removeKey((span, part))
            self.parts.removeKey((span,))
            if len(x) >= self.size:
                cut = np.lib.stride_tricks.sliding_window_view(x, self.size)[:: self.hop]
                out.append(pd.DataFrame({self.by: [key[0]] * len(cut), "frame": range(frame, frame + len(cut)), "x": list(cut)}))
                frame += len(cut)
                used = len(cut) * self.hop
                skip = max(0, used - len(x))
                x = x[used:]
        if self.last.exists() and at == self._end(self.last.get()[0]):
            if frame == 0:
                out.append(pd.DataFrame({self.by: [key[0]], "frame": [0], "x": [np.zeros(self.size)]}))
            self.carry.clear()
            self.last.clear()
        else:
            self.carry.update((int(frame), int(skip), [float(v) for v in x]))
        yield from out

    def close(self) -> None:
        pass


def series_frames(rows: DataFrame, by: str, size: int, hop: int, *, span: str = "1 hour", gap: str = "1 day", ts: str = "ts", number: str = "event_id", value: str = "value") -> DataFrame:
    """(by, frame, x array of ``size``) of a stream with a watermark on ``ts``; ``by`` is a string.  Needs the state store ROCKS."""
    ms = lambda text: int(pd.Timedelta(text) / pd.Timedelta("1ms"))
    narrow = rows.select(by, ts, F.unix_micros(ts).alias("us"), F.col(number).cast("long").alias("number"), F.col(value).cast("double").alias("value"))
    return narrow.groupBy(by).transformWithStateInPandas(SeriesFrames(by, size, hop, ms(span), ms(gap)), f"{by} string, frame long, x array<double>", "Append", "EventTime")
