"""The tasks of a read do not grow with the sound."""

from __future__ import annotations

import numpy as np

from undula.sources import pcm, wav


def test_tasks_are_bounded_and_read_all(tmp_path):
    x = np.arange(10_000, dtype=np.float32).reshape(1, -1)
    (tmp_path / "a.wav").write_bytes(pcm.encode_wav(8000, x))
    reader = wav.WavReader({"path": str(tmp_path), "chunk": "10", "split": "40"})
    parts = reader.partitions()
    assert len(parts) <= wav.MOST_TASKS and sum(1 + len(p.more) for p in parts) == 1000
    assert [v for p in parts for b in reader.read(p) for chunk in b.to_pydict()["x"] for v in chunk] == x[0].tolist()
