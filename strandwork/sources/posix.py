"""Files on a file system that the driver and all executors mount, by byte ranges: headers, parts of files, rotating logs.

Spark's own readers give a file whole or line by line of files that do not change. These sources read only the bytes
that are asked for, and follow files that are renamed.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from strandwork.operators.scans import shares

#: Bytes of a header, entries of a folder that one task walks, bytes of a file that one task reads, and bytes of an Arrow batch.
HEADER, ENTRIES_A_TASK, RANGE, BATCH = 44, 512, 8 << 20, 4 << 20
#: Ranges that one task reads, one after the other.
RANGES_A_TASK = 16


def _local(path: str) -> str:
    return path.removeprefix("file://")


def _hidden(name: str) -> bool:
    return name.startswith((".", "_"))


@dataclass
class Entries(InputPartition):
    """Names in the folder that one task walks."""

    names: list[str]


class FileBytes(DataSource):
    """Format `file_bytes`: (path, length, start, bytes, modified) of files below a folder.

    Options: `path`; `suffix` of the files; `part`, either `listing` (no byte of a file is read), `header` (the first `bytes` of
    each) or `whole`; `tasks` wanted. The driver reads the names in the folder itself; what lies below them is listed by the
    tasks that read it. A file that is gone when its task comes to it has no row.
    """

    @classmethod
    def name(cls) -> str:
        return "file_bytes"

    def schema(self) -> str:
        return "path string, length long, start long, bytes binary, modified timestamp"

    def reader(self, schema) -> DataSourceReader:
        return _FileReader(dict(self.options))


class _FileReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.suffix, self.part = _local(options["path"]), options.get("suffix", ""), options.get("part", "header")
        self.bytes, self.tasks = int(options.get("bytes", HEADER)), int(options.get("tasks", 1))
        if self.part not in ("listing", "header", "whole"):
            raise ValueError(f"no such part: {self.part}")

    def partitions(self) -> list[Entries]:
        names = sorted(os.listdir(self.root)) if os.path.isdir(self.root) else []
        step = max(1, min(ENTRIES_A_TASK, -(-len(names) // self.tasks)))
        return [Entries(names[k : k + step]) for k in range(0, len(names), step)] or [Entries([])]

    def _files(self, names: list[str]) -> Iterator[str]:
        for name in names:
            top = os.path.join(self.root, name)
            if not os.path.isdir(top):
                folders = [(self.root, [], [name])]
            else:
                folders = [] if os.path.islink(top) else os.walk(top)
            for folder, _, found in folders:
                yield from (os.path.join(folder, n) for n in sorted(found) if n.endswith(self.suffix) and not _hidden(n))

    def read(self, partition: Entries) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for path in self._files(partition.names):
            try:
                found, body = os.stat(path), None
                if self.part != "listing":
                    body = _span(path, 0, min(found.st_size, self.bytes) if self.part == "header" else found.st_size)
            except FileNotFoundError:
                continue
            rows.append((path, found.st_size, 0, body, found.st_mtime_ns // 1_000_000 * 1000))
            held += len(path) + len(body or b"")
            if held >= BATCH:
                yield _file_batch(rows)
                rows, held = [], 0
        yield _file_batch(rows)


def _span(path: str, start: int, stop: int) -> bytes:
    with open(path, "rb", buffering=0) as f:
        f.seek(start)
        return b"".join(iter(lambda: f.read(min(1 << 20, stop - f.tell())), b""))


def _file_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.timestamp("us", "UTC"))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "length", "start", "bytes", "modified"])


def _read_ranges(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, length, start, modified in zip(*(batch.column(n).to_pylist() for n in ("path", "length", "start", "modified"))):
            try:
                yield _file_batch([(path, length, start, _span(path, start, min(length, start + size)), modified)])
            except FileNotFoundError:
                continue


@dataclass
class Lines(InputPartition):
    """Bytes [start, stop) of the file of an identity, last seen at `path`."""

    folder: str
    prefix: str
    identity: str
    path: str
    start: int
    stop: int


def identity(path: str) -> str | None:
    """What a log file keeps when it is renamed: its number on the disk and its first line. None before it has a line."""
    with open(path, "rb") as f:
        first = f.readline()
        return f"{os.fstat(f.fileno()).st_ino}:{zlib.crc32(first)}" if first.endswith(b"\n") else None


def _logs(folder: str, prefix: str) -> dict[str, tuple[str, int]]:
    """(path, bytes up to the last whole line) of each log file by identity."""
    out = {}
    for n in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        path = os.path.join(folder, n)
        if not n.startswith(prefix):
            continue
        try:
            key = identity(path)
            if key:
                out[key] = (path, _whole(path))
        except FileNotFoundError:  # renamed meanwhile; the next look finds it
            continue
    return out


def _whole(path: str) -> int:
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at > 0:
            low = max(0, at - (1 << 16))
            f.seek(low)
            cut = f.read(at - low).rfind(b"\n")
            if cut >= 0:
                return low + cut + 1
            at = low
    return 0


class RotatingLog(DataSource):
    """Format `rotating_log`: a stream (value, file, at) of the whole lines of a log and of what it is renamed to.

    Options: `path`, the log's folder; `prefix` of its names (of `app.log`, also `app.log.1` and so on). An offset tells how many
    bytes of each file, by identity and not by name, have been read; so a rotation neither loses nor repeats lines. A file that
    is deleted with lines not yet read stops the stream, unless `missing` is `skip`.
    """

    @classmethod
    def name(cls) -> str:
        return "rotating_log"

    def schema(self) -> str:
        return "value string, file string, at long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _LogReader(dict(self.options))


class _LogReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.prefix, self.skip = _local(options["path"]), options.get("prefix", ""), options.get("missing") == "skip"
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        now = {k: size for k, (_, size) in _logs(self.folder, self.prefix).items()}
        self.seen = {**self.seen, **{k: max(v, self.seen.get(k, 0)) for k, v in now.items()}}
        return self.seen

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        self.seen = {**end, **self.seen}
        paths = _logs(self.folder, self.prefix)
        out = []
        for key, stop in sorted(end.items()):
            for low in range(start.get(key, 0), stop, RANGE):
                out.append(Lines(self.folder, self.prefix, key, paths.get(key, ("", 0))[0], low, min(stop, low + RANGE)))
        return out or [Lines(self.folder, self.prefix, "", "", 0, 0)]

    def read(self, p: Lines) -> Iterator[tuple[str, str, int]]:
        if p.start == p.stop:
            return
        f = self._opened(p)
        if f is None:
            if self.skip:
                return
            raise FileNotFoundError(f"log file {p.identity} is gone with lines {p.start} to {p.stop} unread")
        with f:
            at = p.start
            f.seek(max(0, at - 1))
            if at and f.read(1) != b"\n":  # the line that spans the edge belongs to the range before
                at += len(f.readline())
            while at < p.stop and (line := f.readline()).endswith(b"\n"):
                yield line[:-1].decode("utf-8", "replace"), p.identity, at
                at += len(line)

    def _opened(self, p: Lines):
        """The file of the identity, which may have been renamed since the plan; what is open stays readable."""
        names = [p.path] if p.path else []
        for path in [*names, *(os.path.join(p.folder, n) for n in sorted(os.listdir(p.folder)) if n.startswith(p.prefix))]:
            try:
                f = open(path, "rb")
            except FileNotFoundError:
                continue
            first = f.readline()
            if f"{os.fstat(f.fileno()).st_ino}:{zlib.crc32(first)}" == p.identity:
                return f
            f.close()
        return None

    def commit(self, end: dict) -> None:
        pass


def file_bytes(spark: SparkSession, root: str, part: str = "header", suffix: str = ".wav", **options: str) -> DataFrame:
    """(path, length, start, bytes, modified) of the files below a folder; see `FileBytes`. With `content` each comes in ranges of `bytes`, dealt to tasks."""
    spark.dataSource.register(FileBytes)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = spark.read.format("file_bytes").options(path=root, part="listing" if part == "content" else part, suffix=suffix, tasks=str(tasks), **options).load()
    if part != "content":
        return source
    size = int(options.get("bytes", RANGE))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("long"))
    ranges = source.select("path", "length", F.explode(starts).alias("start"), "bytes", "modified")
    return ranges.repartition(shares(ranges, RANGES_A_TASK)).mapInArrow(lambda batches: _read_ranges(batches, size), source.schema)


def rotating_log(spark: SparkSession, folder: str, prefix: str, **options: str) -> DataFrame:
    """(value, file, at): a log as a stream; see `RotatingLog`."""
    spark.dataSource.register(RotatingLog)
    return spark.readStream.format("rotating_log").options(path=folder, prefix=prefix, **options).load()
