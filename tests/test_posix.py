"""Byte ranges of files and rotating logs on real files."""

import builtins
import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwork.sources import files, posix
from strandwork.sources.sinks import shared_folder


@pytest.fixture()
def stems(tmp_path):
    rng = np.random.default_rng(1)
    for video, role, name, n in (("v1", "vocal", "lead", 50_000), ("v1", "vocal", "back", 40_000), ("v2", "instrumental", "drums", 3)):
        path = tmp_path / video / role / f"{name}.wav"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(files.write_wav(rng.uniform(-1, 1, n), 8000))
    return tmp_path


def test_manifests_need_headers_alone(spark, stems):
    whole, headers = files.manifests(files.stem_files(spark, str(stems))), files.manifests(files.stem_headers(spark, str(stems)))
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, headers.collect()), key=str)
    read = posix.file_bytes(spark, str(stems)).agg(F.sum(F.length("bytes")).alias("read"), F.sum("length").alias("there")).first()
    assert read["read"] == 3 * posix.HEADER and read["there"] > 300_000
    assert posix.file_bytes(spark, str(stems), "listing").where("bytes is null").count() == 3


def test_no_byte_beyond_the_range_is_read(stems, monkeypatch):
    read = []
    true_open = builtins.open

    def counting(path, *a, **k):
        f = true_open(path, *a, **k)
        true_read = f.read

        class Counted:
            seek, tell = f.seek, f.tell
            __enter__ = lambda self: self
            __exit__ = lambda self, *e: f.close()

            def read(self, n):
                got = true_read(n)
                read.append(len(got))
                return got

        return Counted()

    monkeypatch.setattr(builtins, "open", counting)
    reader = posix._FileReader({"path": str(stems), "suffix": ".wav"})
    assert sum(len(list(reader.read(p))) for p in reader.partitions()) == 1 and sum(read) == 3 * posix.HEADER


def test_content_comes_in_ranges(spark, stems):
    rows = posix.file_bytes(spark, f"file://{stems}", "content", bytes="65536").collect()
    assert max(len(r["bytes"]) for r in rows) == 65536 and len(rows) > 5
    for path in {r["path"] for r in rows}:
        assert b"".join(r["bytes"] for r in sorted((r for r in rows if r["path"] == path), key=lambda r: r["start"])) == open(path, "rb").read()
    assert posix.file_bytes(spark, str(stems), suffix=".none").count() == 0
    with pytest.raises(Exception):
        posix.file_bytes(spark, str(stems), "tail").count()


def rotate(folder, keep=5):
    for k in reversed(range(1, keep)):
        if (folder / f"app.log.{k}").exists():
            os.replace(folder / f"app.log.{k}", folder / f"app.log.{k + 1}")
    os.replace(folder / "app.log", folder / "app.log.1")


def put(folder, first, n, tail=""):
    with open(folder / "app.log", "a") as f:
        f.write("".join(f"line {k}\n" for k in range(first, first + n)) + tail)


def start(spark, folder, out):
    rows = posix.rotating_log(spark, str(folder), "app.log").select("value")
    return rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").start()


def test_rotation_neither_loses_nor_repeats_lines(spark, tmp_path, monkeypatch):
    folder, out = tmp_path / "logs", f"{shared_folder(spark)}/rotating-{uuid.uuid4().hex}"
    folder.mkdir()
    (folder / "other.txt").write_text("no\n")
    put(folder, 0, 100, "begun ")
    query = start(spark, folder, out)
    try:
        query.processAllAvailable()
        put(folder, 100, 1)  # ends the begun line
        rotate(folder)
        put(folder, 200, 50)
        query.processAllAvailable()
        rotate(folder)
        rotate_twice = 300
        put(folder, rotate_twice, 50)
        rotate(folder)
        put(folder, 400, 10, "half a line")
        query.processAllAvailable()
    finally:
        query.stop()
    rotate(folder)  # while no stream runs
    put(folder, 500, 5)
    query = start(spark, folder, out)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = sorted(r["value"] for r in spark.read.parquet(f"{out}/rows").collect())
    want = [f"line {k}" for k in [*range(100), *range(200, 250), *range(300, 350), *range(400, 410), *range(500, 505)]] + ["begun line 100"]
    assert got == sorted(want)


def test_ranges_of_a_log_share_no_line(tmp_path, monkeypatch):
    monkeypatch.setattr(posix, "RANGE", 64)
    put(tmp_path, 0, 200)
    reader = posix._LogReader({"path": str(tmp_path), "prefix": "app.log"})
    end = reader.latestOffset()
    parts = reader.partitions({}, end)
    got = [v for p in parts for v, _, _ in reader.read(p)]
    assert len(parts) > 20 and got == [f"line {k}" for k in range(200)]
    os.remove(tmp_path / "app.log")
    with pytest.raises(FileNotFoundError):
        list(reader.read(parts[0]))
    assert list(posix._LogReader({"path": str(tmp_path), "prefix": "app.log", "missing": "skip"}).read(parts[0])) == []


def test_the_driver_reads_no_more_than_the_names_in_the_folder(spark, stems, monkeypatch):
    (stems / "v2" / "instrumental" / "_bass.wav").write_bytes(b"hidden")
    (stems / "top.wav").write_bytes(files.write_wav(np.zeros(3), 8000))
    reader = posix._FileReader({"path": str(stems), "suffix": ".wav", "part": "listing", "tasks": "2"})
    with monkeypatch.context() as m:
        for name in ("walk", "scandir"):
            m.setattr(os, name, None)
        parts = reader.partitions()
    assert [p.names for p in parts] == [["top.wav", "v1"], ["v2"]] and "lead" not in repr(parts)
    found = [r for p in parts for batch in reader.read(p) for r in batch.to_pylist()]
    assert [os.path.relpath(r["path"], stems) for r in found] == ["top.wav", "v1/vocal/back.wav", "v1/vocal/lead.wav", "v2/instrumental/drums.wav"]
    assert all(r["length"] == os.path.getsize(r["path"]) and r["bytes"] is None for r in found)


def test_stem_files_are_listed_and_read_by_tasks(spark, stems, monkeypatch):
    monkeypatch.setattr(posix, "ENTRIES_A_TASK", 1)
    found = files.stem_files(spark, f"file://{stems}")
    assert "binaryFile" not in found._jdf.queryExecution().optimizedPlan().toString() and found.rdd.getNumPartitions() == 2
    rows = {(r.video_id, r.role, r.stem): r for r in found.collect()}
    assert set(rows) == {("v1", "vocal", "lead"), ("v1", "vocal", "back"), ("v2", "instrumental", "drums")}
    for (video, role, stem), r in rows.items():
        path = stems / video / role / f"{stem}.wav"
        assert bytes(r.content) == path.read_bytes() and r.length == path.stat().st_size
    seen = found.select("stem", F.unix_millis("modified").alias("ms")).where("stem = 'drums'").first()
    assert seen.ms == (stems / "v2" / "instrumental" / "drums.wav").stat().st_mtime_ns // 1_000_000
    assert files.stem_files(spark, str(stems / "none")).count() == 0
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(stems)).select(F.unix_millis("modificationTime").alias("ms"), "length")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, found.select(F.unix_millis("modified"), "length").collect()))


def test_whole_files_leave_in_batches_of_bounded_bytes(stems, monkeypatch):
    monkeypatch.setattr(posix, "BATCH", 100_000)
    reader = posix._FileReader({"path": str(stems), "suffix": ".wav", "part": "whole"})
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert [b.num_rows for b in batches] == [1, 1, 1] and sum(len(x) for b in batches for x in b.column("bytes").to_pylist()) > 300_000
