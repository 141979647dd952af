"""Folders of stem files, signal files and caches as tables."""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandwork.operators.resampling import resampled
from strandwork.sources import posix

LEAST_WAV = 1024
#: Samples of a channel in one row.
CHUNK = 1 << 15
#: Samples of an Arrow batch of chunks, as far as whole chunks allow.
BATCH = 1 << 18


def _stems(found: DataFrame, *columns: Column | str) -> DataFrame:
    part = lambda k: F.element_at(F.split("path", "/"), -k)
    return found.select(part(3).alias("video_id"), part(2).alias("role"), F.regexp_replace(part(1), r"\.wav$", "").alias("stem"), "length", *columns)


def stem_files(spark: SparkSession, root: str) -> DataFrame:
    """(video_id, role, stem, length, modified, content) of root/video/role/stem.wav.

    A folder that all machines mount is listed and read by tasks, whatever the number of its files; in a store that only Spark
    reads, the driver lists the files.
    """
    if "://" in root and not root.startswith("file://"):
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(root)
        return _stems(found, F.col("modificationTime").alias("modified"), "content")
    return _stems(posix.file_bytes(spark, root, "whole"), "modified", F.col("bytes").alias("content"))


def stem_headers(spark: SparkSession, root: str) -> DataFrame:
    """(video_id, role, stem, length, content) of root/video/role/stem.wav, of whose content only the header is read.

    `manifests` and `duration_s` need no more. The folder is one that the driver and all executors mount.
    """
    return _stems(posix.file_bytes(spark, root), F.col("bytes").alias("content"))


def intact(content: Column, length: Column) -> Column:
    """Whether bytes begin like a WAV file and are long enough to be one."""
    return (length >= LEAST_WAV) & (F.substring(content, 1, 4) == F.unhex(F.lit("52494646"))) & (F.substring(content, 9, 4) == F.unhex(F.lit("57415645")))


def manifests(files: DataFrame) -> DataFrame:
    """(video_id, role, manifest, intact) of stem files."""
    return files.groupBy("video_id", "role").agg(F.array_sort(F.collect_list("stem")).alias("manifest"), F.bool_and(intact(F.col("content"), F.col("length"))).alias("intact"))


def ready_pairs(manifest: DataFrame, valid: DataFrame, first: str = "vocal", second: str = "instrumental") -> DataFrame:
    """Pairs of videos whose two roles are both complete: all or nothing. `valid` has (role, manifest)."""
    good = manifest.where("intact").join(valid, ["role", "manifest"], "left_semi")
    side = lambda r, s: good.where(F.col("role") == r).select(F.col("video_id").alias(f"video_{s}"))
    return side(first, "a").join(side(second, "b"), F.col("video_a") != F.col("video_b"))


def fresh(entries: DataFrame, now: Column, ttl_s: float, size: str = "length", modified: str = "modified") -> DataFrame:
    """Cache entries that count as hits: not empty, and younger than their time to live (0 or less: of any age)."""
    rows = entries.where(F.col(size) > 0)
    return rows if ttl_s <= 0 else rows.where((F.unix_micros(now) - F.unix_micros(F.col(modified))) / 1e6 <= ttl_s)


def read_wav(blob: bytes) -> tuple[int, np.ndarray] | None:
    """(rate, samples x channels as float32) of PCM or float WAV bytes, None for anything else."""
    if len(blob) < 12 or blob[:4] != b"RIFF" or blob[8:12] != b"WAVE":
        return None
    at, kind = 12, None
    while at + 8 <= len(blob):
        name, size = blob[at : at + 4], struct.unpack_from("<I", blob, at + 4)[0]
        body = blob[at + 8 : at + 8 + size]
        if name == b"fmt ":
            kind = struct.unpack_from("<HHIIHH", body)
        elif name == b"data" and kind:
            code, channels, rate, _, _, bits = kind
            width = bits // 8
            body = body[: len(body) // (width * channels) * width * channels]
            if code == 3 and bits == 32:
                x = np.frombuffer(body, "<f4")
            elif bits == 16:
                x = np.frombuffer(body, "<i2").astype(np.float32) / 32768
            elif bits == 24:
                x = (np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32) << np.array([8, 16, 24])).sum(1, dtype=np.int32).astype(np.float32) / 2**31
            elif bits == 8:
                x = (np.frombuffer(body, np.uint8).astype(np.float32) - 128) / 128
            else:
                return None
            return rate, x.reshape(-1, channels)
        at += 8 + size + size % 2
    return None


def write_wav(samples: np.ndarray, rate: int) -> bytes:
    """Float WAV bytes of samples x channels."""
    x = np.ascontiguousarray(samples, "<f4")
    x = x[:, None] if x.ndim == 1 else x
    fmt = struct.pack("<HHIIHH", 3, x.shape[1], rate, rate * x.shape[1] * 4, x.shape[1] * 4, 32)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", x.nbytes) + x.tobytes()
    return b"RIFF" + struct.pack("<I", len(body)) + body


def write_stems(signals: DataFrame, root: str, rate: int) -> None:
    """Write (video_id, role, stem, samples) as root/video/role/stem.wav, one channel each.

    The folder is one that all machines mount. A file is written beside its place and put there whole, so a task that runs again
    replaces it by the same bytes.
    """
    folder = root.removeprefix("file://")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = zip(*(batch.column(k).to_pylist() for k in range(3)))
            for (video, role, stem), samples in zip(names, batch.column(3)):
                to = os.path.join(folder, video, role)
                part = os.path.join(to, f".{uuid.uuid4().hex}")
                with _opened(part) as f:
                    f.write(write_wav(samples.values.to_numpy(zero_copy_only=False), rate))
                os.replace(part, os.path.join(to, f"{stem}.wav"))
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    signals.select("video_id", "role", "stem", "samples").mapInArrow(write, "n long").agg(F.sum("n")).first()


def _opened(path: str):
    """A new file, whose folder is made if it is missing."""
    try:
        return open(path, "wb")
    except FileNotFoundError:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")


def signal_chunks(files: DataFrame, *, mono: bool = False, chunk: int = CHUNK) -> DataFrame:
    """(video_id, role, stem, channel, rate, chunk, samples) of stem files at their own rates; one channel is doubled unless `mono`."""
    schema = "video_id string, role string, stem string, channel int, rate int, chunk long, samples array<double>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for video, role, stem, content in zip(*batch.columns):
                got = read_wav(content.as_py())
                if got is None:
                    continue
                x = got[1].astype(float)
                x = x.mean(1, keepdims=True) if mono else np.repeat(x[:, :1], 2, 1) if x.shape[1] == 1 else x[:, :2]
                for k in range(0, len(x), chunk):
                    rows += [(video.as_py(), role.as_py(), stem.as_py(), channel, got[0], k // chunk, x[k : k + chunk, channel]) for channel in range(x.shape[1])]
                    held += x[k : k + chunk].size
                    if held >= BATCH:
                        yield _chunk_batch(rows)
                        rows, held = [], 0
            if rows:
                yield _chunk_batch(rows)

    return files.select("video_id", "role", "stem", "content").mapInArrow(read, schema)


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    *parts, samples = zip(*rows)
    kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64())
    ends = np.cumsum([0, *map(len, samples)]).astype(np.int32)
    arrays = [pa.array(p, k) for p, k in zip(parts, kinds)] + [pa.ListArray.from_arrays(ends, np.concatenate(samples))]
    return pa.RecordBatch.from_arrays(arrays, ["video_id", "role", "stem", "channel", "rate", "chunk", "samples"])


def at_rate(chunks: DataFrame, wanted: int = 44100, *, size: int = CHUNK) -> DataFrame:
    """(video_id, role, stem, channel, rate, chunk, first, samples): the signals of `signal_chunks` at one rate.

    The chunks' own rates are few, and each has its weights; chunks of files that have the rate already are as they were.
    """
    keys, out = ["video_id", "role", "stem", "channel"], None
    for r in chunks.select("rate").distinct().collect():
        made = resampled(chunks.where(F.col("rate") == r["rate"]), keys, r["rate"], wanted, size)
        out = made if out is None else out.unionByName(made)
    if out is None:
        return chunks.select(*keys, "rate", "chunk", F.lit(0).cast("long").alias("first"), "samples")
    return out.select(*keys, F.lit(wanted).alias("rate"), "chunk", "first", "samples")


def duration_s(content: Column) -> Column:
    """Seconds of a WAV file with the usual 44-byte header, from its header alone."""
    le = lambda at, n: F.conv(F.hex(F.reverse(F.hex(F.substring(content, at, n)))), 16, 10)  # noqa: E731,F841
    word = lambda at: F.conv(F.concat(*[F.hex(F.substring(content, at + k, 1)) for k in (3, 2, 1, 0)]), 16, 10).cast("long")
    return F.try_divide(word(41).cast("double"), word(29))


def padded(stems: DataFrame, dimension: list[str], key: str, stem: str, samples: str) -> DataFrame:
    """Every stem of the dimension for each key; a missing one is silence as long as the key's longest."""
    spark = stems.sparkSession
    names = spark.createDataFrame([(s,) for s in dimension], f"{stem} string")
    keys = stems.groupBy(key).agg(F.max(F.size(samples)).alias("_n"))
    every = keys.join(F.broadcast(names))
    return every.join(stems, [key, stem], "left").select(key, stem, F.coalesce(samples, F.array_repeat(F.lit(0.0).cast("float"), F.col("_n"))).alias(samples))
