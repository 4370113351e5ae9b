"""Tones of recordings whose channels are not equally long."""

from __future__ import annotations

import numpy as np
import pytest

from undula.operators import audio as AU
from undula.sources import pcm


def test_tones_of_channels_that_end_apart(spark):
    sr, chunk = 8000, 16000
    tone = lambda n: (0.5 * np.sin(2 * np.pi * 500 * np.arange(n) / sr)).astype(np.float32)
    sounds = {("left", 0): tone(60000), ("left", 1): tone(21000), ("right", 0): tone(21000), ("right", 1): tone(60000), ("one", 0): tone(60000)}
    rows = [(f, c, k // chunk, sr, x[k : k + chunk].tolist()) for (f, c), x in sounds.items() for k in range(0, len(x), chunk)]
    got = {r.file: r for r in AU.tone_steps(spark.createDataFrame(rows, pcm.CHUNKS), sr, chunk).collect()}
    assert set(got) == {"left", "right", "one"} and all(r.seconds == 7.5 and r.hz == pytest.approx(500, abs=1) for r in got.values())
    assert got["left"].level_0 - got["left"].level_1 > 60 and got["right"].level_1 - got["right"].level_0 > 60
    assert got["one"].level_0 == got["one"].level_1
