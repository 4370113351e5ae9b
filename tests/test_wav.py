from __future__ import annotations

import numpy as np
import pytest

from undula.sources import pcm, wav

SCHEMA = "file string, ch int, chunk long, sr int, x array<float>"


def sound(seed=0):
    rng = np.random.default_rng(seed)
    return {("a", 2): rng.normal(0, 0.3, (2, 1000)).astype(np.float32), ("b", 1): rng.normal(0, 0.3, (1, 17)).astype(np.float32), ("c", 1): rng.normal(0, 0.3, (1, 640)).astype(np.float32)}


def table(spark, found, size):
    rows = [(f, c, k // size, 8000, x[c, k : k + size].tolist()) for (f, n), x in found.items() for c in range(n) for k in range(0, x.shape[1], size)]
    return spark.createDataFrame(rows, SCHEMA)


def whole(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["chunk"]):
        out.setdefault((r["file"], r["ch"]), []).extend(r["x"])
    return out


def test_written_and_read_by_ranges(spark, tmp_path):
    found = sound()
    folder = str(tmp_path / "out")
    wav.write_wav(table(spark, found, 64), folder, 64)
    assert not [p for p in (tmp_path / "out").rglob("*") if p.name.startswith(".")]
    for split in (1, 64 * 8 * 3, 1 << 20):
        got = wav.read_wav(spark, folder, chunk=64, split=split)
        assert whole(got) == {(f, c): x[c].tolist() for (f, n), x in found.items() for c in range(n)}
        assert all(r["sr"] == 8000 and len(r["x"]) <= 64 for r in got.collect())


def test_one_file_over_several_tasks(spark, tmp_path):
    x = np.arange(3000, dtype=np.float32).reshape(1, -1) / 4096
    (tmp_path / "one.wav").write_bytes(pcm.encode_wav(8000, x))
    (tmp_path / "noise.wav").write_bytes(b"RIFF not sound")
    (tmp_path / "other.txt").write_bytes(b"x")
    got = wav.read_wav(spark, str(tmp_path), chunk=100, split=100 * 4 * 7)
    assert got.rdd.getNumPartitions() == 5
    assert whole(got) == {("one.wav", 0): x[0].tolist()}


def test_reader_takes_only_its_bytes(tmp_path):
    x = np.zeros((1, 1_000_000), np.float32)
    path = tmp_path / "long.wav"
    path.write_bytes(pcm.encode_wav(8000, x))
    reader = wav.WavReader({"path": str(path), "chunk": "1000", "split": "400000"})
    parts = reader.partitions()
    assert len(parts) == 10 and all(p.end - p.first == 100_000 for p in parts)
    assert sum(b.num_rows for b in reader.read(parts[3])) == 100


def test_abort_removes_parts_and_retries_leave_nothing(tmp_path):
    from pyspark.sql import Row

    rows = [Row(file="a", first=0, sr=8000, x=[[0.0, 1.0]]), Row(file="a", first=2, sr=8000, x=[[0.5]]), Row(file="a", first=9, sr=8000, x=[[0.25]])]
    writer = wav.WavWriter({"path": str(tmp_path)})
    lost, kept = writer.write(iter(rows)), writer.write(iter(rows))
    assert len(kept.made) == 2  # samples 0 to 2 are one part
    writer.commit([kept, None])
    writer.abort([lost])
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == [f"{0:015d}.wav", f"{9:015d}.wav"]


def test_no_files(spark, tmp_path):
    assert wav.read_wav(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="append"):
        table(spark, sound(), 64).write.format("wav").option("path", str(tmp_path)).mode("overwrite").save()


def test_files_of_all_extensions_are_found(spark, tmp_path):
    names = ["a.wav", "b.FLAC", "c.mp+", "d.8svx", "e.m2ts", "f.txt", "g", "h.mp4x", ".hidden.wav"]
    for n in names:
        (tmp_path / n).write_bytes(b"x")
    got = {r["path"].rpartition("/")[2] for r in pcm.media_files(spark, str(tmp_path)).select("path").collect()}
    assert got == {"a.wav", "b.FLAC", "c.mp+", "d.8svx", "e.m2ts"}
