"""WAV sound as a Spark data source: read by ranges of bytes, written in parts.

    spark.dataSource.register(WavSource)
    spark.read.format("wav").option("path", folder).option("chunk", 65536).load()
    sound.write.format("wav").option("path", folder).mode("append").save()

Reading looks at the head of each file only, and cuts its samples into ranges of
about ``split`` bytes on the borders of chunks; a task reads its ranges, so one
long file is spread over many tasks and files may be larger than memory.

A recording is a file, or a folder of parts whose names are the number of their
first sample; a part starts with a whole chunk.  Writing makes such folders: rows are
(file, first, sr, x array<array<float>>), all channels of a run of samples, and runs
that follow each other in a task become one part.  Parts have names of their own
until the job commits; if it aborts they are removed.

Paths are those of ``pyarrow.fs``, on a store that all executors share.  Files that are
no readable WAV sound give no rows; ``heads`` tells why.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from undula.sources.pcm import CHUNKS, HEAD, encode_wav, parse_wav, samples_of_bytes

WRITTEN = "file string, first long, sr int, x array<array<float>>"
#: A read has about so many tasks at most, and each at least as many ranges as that takes.
MOST_TASKS = 256
#: Names of parts: the first sample, in so many digits that names sort like numbers.
_PART = re.compile(r"(.*)/(\d{15})\.wav$")


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> Iterator[tuple[str, int]]:
    store, at = _store(path)
    found = store.get_file_info(at)
    if found.type == fs.FileType.File:
        found = [found]
    elif found.type == fs.FileType.Directory:
        found = store.get_file_info(fs.FileSelector(at, recursive=True))
    else:
        raise FileNotFoundError(path)
    for f in sorted(found, key=lambda f: f.path):
        if f.type == fs.FileType.File and f.path.lower().endswith(".wav") and not f.base_name.startswith("."):
            yield f.path, f.size


def _head(store: fs.FileSystem, path: str, size: int) -> dict:
    with store.open_input_file(path) as f:
        return parse_wav(f.read(min(size, HEAD)), size)


@dataclass
class Range(InputPartition):
    """Samples ``first`` to ``end`` of a file, which are ``base`` further on in their recording, and ranges that the same task reads after it."""

    path: str
    file: str
    head: dict
    base: int
    first: int
    end: int
    more: tuple[Range, ...] = ()


class WavReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.chunk, self.split = options["path"], int(options.get("chunk", 1 << 16)), int(options.get("split", 1 << 26))

    def partitions(self) -> list[Range]:
        store, out = _store(self.path)[0], []
        for path, size in _files(self.path):
            try:
                head = _head(store, path, size)
            except (ValueError, struct.error):
                continue
            part = _PART.match(path)
            file, base = (part[1], int(part[2])) if part else (path, 0)
            if base % self.chunk:
                raise ValueError(f"{path} does not start with a chunk of {self.chunk} samples")
            each = max(1, self.split // (head["align"] * self.chunk)) * self.chunk
            total = head["bytes"] // head["align"]
            out += [Range(path, file.rpartition("/")[2], head, base, first, min(total, first + each)) for first in range(0, total, each)]
        # However small a range is, the tasks do not grow with the sound.
        each = -(-len(out) // MOST_TASKS)
        if each > 1:
            out = [replace(out[k], more=tuple(out[k + 1 : k + each])) for k in range(0, len(out), each)]
        return out or [Range("", "", {}, 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for one in (partition, *partition.more):
            yield from self._read(one)

    def _read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        head = partition.head
        with _store(self.path)[0].open_input_file(partition.path) as f:
            for at in range(partition.first, partition.end, self.chunk):
                f.seek(head["at"] + at * head["align"])
                x = samples_of_bytes(f.read((min(partition.end, at + self.chunk) - at) * head["align"]), head)
                n, number = len(x), (partition.base + at) // self.chunk
                yield pa.RecordBatch.from_pydict({
                    "file": [partition.file] * n, "ch": pa.array(range(n), pa.int32()), "chunk": pa.array([number] * n, pa.int64()), "sr": pa.array([head["rate"]] * n, pa.int32()),
                    "x": pa.array(list(x), pa.list_(pa.float32())),
                })


@dataclass
class Parts(WriterCommitMessage):
    made: list[tuple[str, str]]


class WavWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.job = options["path"], uuid.uuid4().hex

    def write(self, iterator) -> Parts:
        store, root = _store(self.path)
        made, held = [], []

        def close() -> None:
            if not held:
                return
            file, first, rate = held[0]["file"], held[0]["first"], held[0]["sr"]
            folder = f"{root}/{file}"
            store.create_dir(folder, recursive=True)
            hidden = f"{folder}/.{first:015d}-{self.job}-{uuid.uuid4().hex}"
            with store.open_output_stream(hidden) as f:
                f.write(encode_wav(rate, np.concatenate([np.asarray([list(c) for c in r["x"]], np.float32) for r in held], axis=1)))
            made.append((hidden, f"{folder}/{first:015d}.wav"))
            held.clear()

        size = 0
        for row in iterator:
            row = row.asDict()
            follows = held and row["file"] == held[-1]["file"] and row["sr"] == held[-1]["sr"] and len(row["x"]) == len(held[-1]["x"]) and row["first"] == held[-1]["first"] + len(held[-1]["x"][0])
            if not follows or size > 1 << 24:
                close()
                size = 0
            held.append(row)
            size += len(row["x"]) * len(row["x"][0])
        close()
        return Parts(made)

    def commit(self, messages) -> None:
        store = _store(self.path)[0]
        for m in messages:
            for hidden, name in m.made if m else ():
                store.move(hidden, name)

    def abort(self, messages) -> None:
        store = _store(self.path)[0]
        for m in messages:
            for hidden, _ in m.made if m else ():
                store.delete_file(hidden)


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return CHUNKS

    def reader(self, schema) -> WavReader:
        return WavReader(self.options)

    def writer(self, schema, overwrite: bool) -> WavWriter:
        if overwrite:
            raise ValueError("recordings are only added: use mode('append') and a new folder")
        return WavWriter(self.options)


def read_wav(spark: SparkSession, path: str, *, chunk: int = 1 << 16, split: int = 1 << 26) -> DataFrame:
    """Chunks of all channels of the recordings below ``path``."""
    spark.dataSource.register(WavSource)
    return spark.read.format("wav").option("path", path).option("chunk", chunk).option("split", split).load()


def write_wav(chunks: DataFrame, path: str, chunk: int) -> None:
    """Chunks (file, ch, chunk, sr, x) as recordings of 32-bit samples below ``path``; a file's channels are equally long."""
    chunks.sparkSession.dataSource.register(WavSource)
    sides = F.array_sort(F.collect_list(F.struct("ch", F.col("x").cast("array<float>").alias("x"))))
    # A chunk has a row for each channel, so what is gathered is bounded.
    rows = chunks.filter(F.size("x") > 0).groupBy("file", "chunk").agg(F.max("sr").alias("sr"), sides.alias("s"))
    rows = rows.select(F.col("file").cast("string").alias("file"), (F.col("chunk") * chunk).cast("long").alias("first"), F.col("sr").cast("int").alias("sr"), F.transform("s", lambda s: s["x"]).alias("x"))
    rows.repartitionByRange("file", "first").sortWithinPartitions("file", "first").write.format("wav").option("path", path).mode("append").save()
