"""PCM sound as tables of chunks, and the way back.

Samples are rows (file, ch, chunk, sr, x array<float>): chunks of one length but
the last, one row for each channel.  WAV files are read as binary files, so any
store that Spark reaches will do; a file is decoded by the task that holds it,
and what follows works by chunk.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS = "file string, ch int, chunk long, sr int, x array<float>"
PROBE = "path string, name string, sample_rate int, channels int, bits int, sample_fmt string, container string, codec string, duration double, size long, error string"
#: Bytes of a file in which its format is looked for.
HEAD = 1 << 20
#: File name extensions that a folder is searched for; sound without loss, sound with loss, containers that may hold some.
EXTENSIONS = (
    "flac", "wav", "w64", "rf64", "aiff", "aif", "aifc", "caf", "au", "snd", "alac", "ape", "wv", "tta", "tak", "shn", "als", "mlp", "thd", "truehd", "dsf", "dff", "dsdiff", "bwf", "8svx", "voc", "sln", "pcm", "raw",
    "mp3", "mp2", "mp1", "m4a", "m4b", "aac", "adts", "ogg", "oga", "opus", "spx", "vorbis", "wma", "asf", "ac3", "eac3", "dts", "dtshd", "amr", "awb", "gsm", "mpc", "mp+", "ra", "rm", "qcp", "aa", "aax", "sbc",
    "mka", "mkv", "mp4", "mov", "m4v", "webm", "avi", "ts", "m2ts", "mts", "vob", "flv", "3gp", "3g2", "wtv", "ogv", "mxf",
)


def parse_wav(content: bytes, length: int | None = None) -> dict:
    """Format and place of the samples of a RIFF WAVE file of ``length`` bytes, of which ``content`` may be the head; raises ValueError with the reason."""
    length = len(content) if length is None else length
    if len(content) < 12 or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, found = 12, {}
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack("<I", content[at + 4 : at + 8])[0]
        if name == b"fmt ":
            code, channels, rate, _, align, bits = struct.unpack("<HHIIHH", content[at + 8 : at + 24])
            if code == 0xFFFE and size >= 40:
                code = struct.unpack("<H", content[at + 32 : at + 34])[0]
            found |= {"code": code, "channels": channels, "rate": rate, "align": align, "bits": bits}
        elif name == b"data":
            found |= {"at": at + 8, "bytes": min(size, length - at - 8)}
        at += 8 + size + size % 2
    if "code" not in found or "at" not in found:
        raise ValueError("no format or no samples")
    if (found["code"], found["bits"]) not in ((1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)):
        raise ValueError(f"format {found['code']} with {found['bits']} bits is not read")
    return found


def decode_wav(content: bytes, start: float = 0.0, seconds: float | None = None) -> tuple[int, np.ndarray]:
    """(rate, samples by channel from -1 to 1) of a slice of time; only that slice is converted."""
    f = parse_wav(content)
    first = int(start * f["rate"]) * f["align"]
    size = f["bytes"] if seconds is None else min(f["bytes"], first + int(seconds * f["rate"]) * f["align"])
    return f["rate"], samples_of_bytes(content[f["at"] + first : f["at"] + size], f)


def samples_of_bytes(raw: bytes, f: dict) -> np.ndarray:
    """Samples by channel, from -1 to 1, of a piece of the data of a file with format ``f``; a broken last sample is left out."""
    raw = raw[: len(raw) // f["align"] * f["align"]]
    if f["code"] == 3:
        x = np.frombuffer(raw, "<f4" if f["bits"] == 32 else "<f8").astype(np.float32)
    elif f["bits"] == 8:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif f["bits"] == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / 2**23
    else:
        x = np.frombuffer(raw, f"<i{f['bits'] // 8}").astype(np.float32) / 2.0 ** (f["bits"] - 1)
    return x.reshape(-1, f["channels"]).T


def encode_wav(rate: int, samples: np.ndarray) -> bytes:
    """32-bit float WAVE of samples by channel."""
    data = np.ascontiguousarray(samples.T, "<f4").tobytes()
    channels = len(samples)
    head = b"fmt " + struct.pack("<IHHIIHH", 16, 3, channels, rate, rate * channels * 4, channels * 4, 32)
    return b"RIFF" + struct.pack("<I", 4 + len(head) + 8 + len(data)) + b"WAVE" + head + b"data" + struct.pack("<I", len(data)) + data


def media_files(spark: SparkSession, folder: str, *, recursive: bool = True, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Files of a folder (path, modificationTime, length, content); contents are read only where they are asked for."""
    pattern = "*.{" + ",".join([*extensions, *(e.upper() for e in extensions)]) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).load(folder)
    return found.filter(~F.col("path").rlike(r"/\.[^/]"))


def probe(files: DataFrame) -> DataFrame:
    """Technical data of each file; what cannot be read gets an error and nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, size, content in zip(batch["path"], batch["length"], batch["content"]):
                row = dict.fromkeys(("path", "name", "sample_rate", "channels", "bits", "sample_fmt", "container", "codec", "duration", "size", "error")) | {"path": path, "name": path.rpartition("/")[2], "size": int(size)}
                try:
                    f = parse_wav(bytes(content), int(size))
                    kind = {32: "flt", 64: "dbl"}[f["bits"]] if f["code"] == 3 else {8: "u8", 16: "s16"}.get(f["bits"], "s32")
                    codec = "pcm_u8" if kind == "u8" else f"pcm_{'f' if f['code'] == 3 else 's'}{f['bits']}le"
                    row |= {"sample_rate": f["rate"], "channels": f["channels"], "bits": f["bits"], "sample_fmt": kind, "container": "wav", "codec": codec, "duration": f["bytes"] / f["align"] / f["rate"]}
                except (ValueError, struct.error) as e:
                    row["error"] = str(e)[:200]
                rows.append(row)
            yield pd.DataFrame(rows)

    return files.select("path", "length", F.substring("content", 1, HEAD).alias("content")).mapInPandas(run, PROBE)


def read_samples(files: DataFrame, *, chunk: int = 1 << 16, start: float = 0.0, seconds: float | None = None) -> DataFrame:
    """Chunks of all channels of readable files; others give no rows (``probe`` tells why)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rate, x = decode_wav(bytes(content), start, seconds)
                except (ValueError, struct.error):
                    continue
                for k in range(0, x.shape[1], chunk):
                    yield pd.DataFrame({"file": path, "ch": range(len(x)), "chunk": k // chunk, "sr": rate, "x": list(x[:, k : k + chunk])})

    return files.select("path", "content").mapInPandas(run, CHUNKS)


def synthetic(spark: SparkSession, seconds: dict[str, float], sound: dict, *, sr: int, chunk: int = 1 << 14) -> DataFrame:
    """Chunks of made-up sound: ``sound[file](t)`` gives the channels (expressions of the time in seconds) as a list.  JVM only."""
    out = None
    for file, length in seconds.items():
        n = int(length * sr)
        rows = spark.range(-(-n // chunk)).select(F.col("id").alias("chunk"))
        at = F.sequence(F.col("chunk") * chunk, F.least((F.col("chunk") + 1) * chunk, F.lit(n)) - 1)
        for ch in range(len(sound[file](F.lit(0.0)))):
            part = rows.select(F.lit(file).alias("file"), F.lit(ch).alias("ch"), "chunk", F.lit(sr).alias("sr"), F.transform(at, _voice(sound[file], sr, ch)).alias("x"))
            out = part if out is None else out.unionByName(part)
    return out


def _voice(sound, sr: int, ch: int):
    return lambda i: sound(i / F.lit(float(sr)))[ch].cast("float")
