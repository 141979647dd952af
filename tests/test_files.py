"""File sources, sinks, documents and shelves on real files."""

import datetime
import json
import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from strandwork.functions import keys
from strandwork.plans import catalogue, dashboard
from strandwork.sources import documents, files, logs, sinks

def now():
    return F.lit("2024-03-02 00:00:00").cast("timestamp")


@pytest.fixture()
def stems(tmp_path):
    rng = np.random.default_rng(1)
    for video, role, names in (("v1", "vocal", ("lead", "back")), ("v2", "instrumental", ("drums", "bass")), ("v3", "vocal", ("lead",))):
        for name in names:
            path = tmp_path / video / role / f"{name}.wav"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(files.write_wav(rng.uniform(-1, 1, (2000, 1 if name == "bass" else 2)), 22050))
    (tmp_path / "v3" / "vocal" / "back.wav").write_bytes(b"RIFF....WAVE")
    (tmp_path / "v3" / "vocal" / "note.txt").write_text("no")
    return tmp_path


def test_listing_manifests_and_pairs(spark, stems):
    found = files.stem_files(spark, str(stems))
    assert sorted((r["video_id"], r["role"], r["stem"]) for r in found.collect()) == [("v1", "vocal", "back"), ("v1", "vocal", "lead"), ("v2", "instrumental", "bass"), ("v2", "instrumental", "drums"), ("v3", "vocal", "back"), ("v3", "vocal", "lead")]
    manifest = files.manifests(found)
    rows = {r["video_id"]: (r["manifest"], r["intact"]) for r in manifest.collect()}
    assert rows == {"v1": (["back", "lead"], True), "v2": (["bass", "drums"], True), "v3": (["back", "lead"], False)}
    valid = spark.createDataFrame([("vocal", ["back", "lead"]), ("instrumental", ["bass", "drums"])], "role string, manifest array<string>")
    assert [tuple(r) for r in files.ready_pairs(manifest, valid).collect()] == [("v1", "v2")]


def test_wav_bytes_round_trip_and_refuse_others():
    x = np.random.default_rng(2).uniform(-1, 1, (100, 2)).astype(np.float32)
    rate, back = files.read_wav(files.write_wav(x, 48000))
    assert rate == 48000 and np.array_equal(back, x)
    assert files.read_wav(b"") is None and files.read_wav(b"RIFF1234WAVX") is None
    pcm = b"fmt " + (16).to_bytes(4, "little") + (1).to_bytes(2, "little") + (1).to_bytes(2, "little") + (8000).to_bytes(4, "little") + (16000).to_bytes(4, "little") + (2).to_bytes(2, "little") + (16).to_bytes(2, "little")
    data = np.array([0, 16384, -32768], "<i2").tobytes()
    blob = b"RIFF\0\0\0\0WAVE" + pcm + b"LIST" + (2).to_bytes(4, "little") + b"ab" + b"data" + len(data).to_bytes(4, "little") + data
    assert files.read_wav(blob)[1].ravel().tolist() == [0.0, 0.5, -1.0]


def test_signals_at_one_rate_in_chunks(spark, stems):
    found = files.stem_files(spark, str(stems))
    rows = files.at_rate(files.signal_chunks(found, chunk=150), 44100, size=150).collect()
    assert {r["video_id"] for r in rows} == {"v1", "v2", "v3"} and not any(r["video_id"] == "v3" and r["stem"] == "back" for r in rows)
    parts = sorted((r for r in rows if r["stem"] == "bass"), key=lambda r: (r["channel"], r["first"]))
    one = [np.concatenate([r["samples"] for r in parts if r["channel"] == k]) for k in (0, 1)]
    assert len(one[0]) == 4000 and np.array_equal(*one) and all(r["rate"] == 44100 for r in rows)
    x = files.read_wav((stems / "v2" / "instrumental" / "bass.wav").read_bytes())[1][:, 0]
    assert np.allclose(one[0][::2], x, atol=1e-9)
    mono = files.at_rate(files.signal_chunks(found, mono=True), 22050).where("stem = 'drums'").first()["samples"]
    assert np.allclose(mono, files.read_wav((stems / "v2" / "instrumental" / "drums.wav").read_bytes())[1].mean(1), atol=1e-6)
    assert files.at_rate(files.signal_chunks(found.where("stem = 'none'"))).count() == 0


def test_missing_stems_are_silence(spark):
    rows = spark.createDataFrame([("a", "drums", [1.0, 2.0, 3.0]), ("a", "bass", [4.0]), ("b", "bass", [5.0])], "song string, stem string, samples array<float>")
    out = {(r["song"], r["stem"]): r["samples"] for r in files.padded(rows, ["drums", "bass", "piano"], "song", "stem", "samples").collect()}
    assert out["a", "piano"] == [0.0] * 3 and out["b", "drums"] == [0.0] and out["a", "drums"] == [1.0, 2.0, 3.0] and len(out) == 6


def test_header_duration_and_cache_age(spark, stems):
    found = files.stem_files(spark, str(stems)).where("video_id <> 'v3'")
    # the length of a header is 44 bytes for plain PCM
    pcm = files.write_wav(np.zeros((0, 1)), 8000)[:36] + b"data" + (16000).to_bytes(4, "little")
    pcm = pcm[:28] + (16000).to_bytes(4, "little") + pcm[32:]
    assert spark.createDataFrame([(pcm,)], "c binary").select(files.duration_s(F.col("c"))).first()[0] == 1.0
    entries = spark.createDataFrame([("a", 5, 10), ("b", 5, 100), ("c", 0, 10)], "k string, length int, age int").withColumn("modified", now() - F.make_dt_interval(secs=F.col("age")))
    assert sorted(r["k"] for r in files.fresh(entries, now(), 60).collect()) == ["a"]
    assert sorted(r["k"] for r in files.fresh(entries, now(), 0).collect()) == ["a", "b"]
    assert found.count() == 4


def test_log_is_written_and_reported(spark, tmp_path):
    rows = spark.createDataFrame([("2024-03-01T10:00:00", "INFO", "summary", 12.3456, "v", None), ("2024-03-01T11:00:00", "INFO", "summary", 2.5, "w", "x")], "asctime string, levelname string, pipeline_step string, total_pipeline_time_s double, song_a_video_id string, red_flag string")
    sinks.write_log(sinks.log_lines(rows, {"total_pipeline_time_s": 1}), str(tmp_path / "log"))
    sinks.write_log(spark.createDataFrame([("broken {",)], "value string"), str(tmp_path / "log"))
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "log")).collect() if r["value"][0] == "{"]
    assert sorted(x["total_pipeline_time_s"] for x in lines) == [2.5, 12.3] and all("timestamp" in x and "level" in x for x in lines) and sum("red_flag" in x for x in lines) == 1
    report = {(r["metric"], r["key"]): (r["n"], r["value"]) for r in dashboard.from_log(spark, str(tmp_path / "log"), now()).collect()}
    assert report["day", "2024-03-01"][0] == report["total", "all"][0] == 2 and report["time", "all"] == (2, 7.4) and report["flag", "x"][0] == 1 and report["used", "v"][0] == 1
    assert dashboard.from_log(spark, str(tmp_path / "none"), now()).count() == 0
    assert dashboard.from_log(spark, str(tmp_path / "log"), now() + F.expr("INTERVAL 90 DAYS"), 7).count() == 0
    with pytest.raises(ValueError):
        dashboard.from_log(spark, str(tmp_path / "log"), now(), 0)


def test_a_table_is_replaced_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_table(spark.range(3), path)
    with pytest.raises(ValueError):
        sinks.replace_table(spark.range(5), path, lambda staged: staged.count() == 4)
    assert spark.read.parquet(path).count() == 3
    sinks.replace_table(spark.range(5), path, lambda staged: staged.count() == 5)
    assert spark.read.parquet(path).count() == 5 and sorted(os.listdir(tmp_path)) == ["t"]


def test_upserts_checkpoints_and_two_targets(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "k string, v int, s string")
    new = spark.createDataFrame([("a", 2, "new"), ("b", 4, "late"), ("c", 1, "z")], "k string, v int, s string")
    assert sorted(map(tuple, sinks.upserted(old, new, "k", "v").collect())) == [("a", 2, "new"), ("b", 5, "y"), ("c", 1, "z")]
    path = str(tmp_path / "c")
    for batch in (old, new, new):
        sinks.append_absent(batch, path, "k")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1, "x"), ("b", 5, "y"), ("c", 1, "z")]
    done = []

    def second(batch, epoch):
        raise OSError("down")

    sinks.in_order(lambda batch, epoch: done.append((epoch, batch.count())), second)(new, 7)
    assert done == [(7, 3)]


def test_sleeves_escape_their_text(spark):
    rows = spark.createDataFrame([(f"u{k}", 'A & "B" <C>', "D") for k in range(12)], "url string, title string, artist string").withColumn("p", keys.palette(F.col("url")))
    out = [(r["p"]["variant"], r["p"]["c0"], r["svg"]) for r in rows.select("p", sinks.sleeve_svg(F.col("title"), F.col("artist"), F.col("p")).alias("svg")).collect()]
    assert {v for v, *_ in out} == {0, 1, 2}
    for variant, colour, svg in out:
        assert "A &amp; &quot;B&quot; &lt;C&gt;" in svg and colour in svg and ("<circle", 'x="60"', "<path")[variant] in svg


def test_shelves_and_seeds(spark, tmp_path):
    (tmp_path / "shelf.json").write_text(json.dumps({"records": [{"id": "1", "title": "T", "is_curated": True}, {"id": "2", "added_at": "2024"}]}))
    rows = documents.shelf(spark, str(tmp_path / "shelf.json")).collect()
    assert [(r["place"], r["id"], r["title"], r["is_curated"]) for r in rows] == [(0, "1", "T", True), (1, "2", None, None)]
    links = [(f"https://x.example/{k}", f"t{k}", "a") for k in range(7)]
    seeds = documents.seeds(spark, links, "2024-01-01 00:05:00").collect()
    assert [r["added_at"] for r in seeds][:7] == [f"{datetime.datetime(2024, 1, 1, 0, 5) - datetime.timedelta(minutes=k):%Y-%m-%dT%H:%M:%S}+00:00" for k in range(7)]
    assert [r["id"] for r in seeds] == [str(uuid.uuid5(uuid.NAMESPACE_URL, u)) for u, *_ in links] and all(r["is_curated"] for r in seeds)


def test_name_based_ids(spark):
    names = ["", "a", "https://x.example/é", "漢" * 100]
    out = spark.createDataFrame([(n,) for n in names], "n string").select(keys.record_id(F.col("n"))).collect()
    assert [r[0] for r in out] == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_song_documents_are_parsed_once(spark):
    plan = catalogue.queries()["song_documents"](spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and plan.count("parseJson") == 1


def test_facts_of_a_song_equal_its_exploded_parts(spark):
    song = {"stem_analysis": {"bar_rms": {"drums": [0.1, None], "bass": [], "piano": None}}, "song_structure": {"sections": [{"label": "a", "start_time": 1.5, "annotations": ["n", "m"]}, {"label": "b", "annotations": []}, {}]}, "word_alignment": {"words": [{"text": "x", "start_ms": 7}, {"start_ms": 8}]}}
    texts = [("s", json.dumps(song)), ("old", '{"bpm": 90}'), ("words", '{"word_alignment": {"words": [{"text": "y"}]}, "song_structure": {"sections": null}}'), ("bad", "{"), ("null", None)]
    songs = documents.with_decoded(spark.createDataFrame(texts, "id string, json string"), "json", documents.SONG)
    assert {r["id"]: r["doc"] is None for r in songs.collect()} == {"s": False, "old": False, "words": False, "bad": True, "null": True}
    rows = songs.select("id", F.explode(documents.facts()).alias("f")).select("id", "f.*").collect()
    bars = [("s", "bar", *r[1:], []) for r in documents.exploded_bars(songs, "id").collect()]
    sections = [("s", "section", r["label"], r["idx"], r["start_time"], r["annotations"]) for r in documents.exploded_sections(songs, "id").collect()]
    words = [("s", "word", "x", 0, 7.0, []), ("s", "word", None, 1, 8.0, []), ("words", "word", "y", 0, None, [])]
    assert len(bars) == 2 and len(sections) == 3 and sorted(map(repr, map(tuple, rows))) == sorted(map(repr, bars + sections + words))


def test_songs_as_documents(spark):
    song = {"bpm": 120.0, "key": "C", "stem_analysis": {"bar_rms": {"drums": [0.1, 0.2], "bass": [0.3]}, "bucket_thresholds": {"p10": 0.1}}, "song_structure": {"sections": [{"start_bar": 0, "end_bar": 4, "label": "intro", "annotations": ["x"]}, {"start_bar": 4, "end_bar": 8, "label": "verse"}], "total_bars": 8}}
    rows = spark.createDataFrame([("s", json.dumps(song)), ("old", '{"bpm": 90}'), ("bad", "{")], "song_id string, json string").withColumn("doc", documents.decoded(F.col("json"), documents.SONG))
    docs = {r["song_id"]: r["doc"] for r in rows.collect()}
    assert docs["bad"] is None and docs["old"]["bpm"] == 90 and docs["old"]["stem_analysis"] is None and docs["s"]["stem_analysis"]["bucket_thresholds"]["p10"] == 0.1
    bars = documents.exploded_bars(rows.where("doc is not null"), "song_id").collect()
    assert sorted(map(tuple, bars)) == [("s", "bass", 0, 0.3), ("s", "drums", 0, 0.1), ("s", "drums", 1, 0.2)]
    sections = documents.exploded_sections(rows.where("doc is not null"), "song_id").collect()
    assert [(r["idx"], r["label"], r["annotations"]) for r in sections] == [(0, "intro", ["x"]), (1, "verse", None)]
    back = rows.where("song_id = 's'").select(documents.encoded(F.col("doc"))).first()[0]
    assert json.loads(back) == song


def test_lines_of_a_growing_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text('{"timestamp": "2024-01-01T00:00:00", "x": 1}\nno\n')
    stream = logs.records(logs.tail(spark, str(tmp_path / "in"))).select("raw_ts")
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r[0] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["2024-01-01T00:00:00"]


def test_chunks_of_many_files_leave_in_few_arrow_batches(spark):
    made = [(f"v{k}", "vocal", "drums", files.write_wav(np.full(10, k / 8), 8000)) for k in range(5)]
    rows = spark.createDataFrame([(v, r, s, bytearray(b)) for v, r, s, b in made], "video_id string, role string, stem string, content binary").coalesce(1)
    chunks = files.signal_chunks(rows, chunk=4)
    assert "MapInArrow" in chunks._jdf.queryExecution().optimizedPlan().toString()
    got = {(c.video_id, c.channel, c.chunk): (c.rate, list(c.samples)) for c in chunks.collect()}
    assert got == {(f"v{k}", channel, n): (8000, [k / 8] * (4 if n < 2 else 2)) for k in range(5) for channel in range(2) for n in range(3)}
    batch = files._chunk_batch([("v", "vocal", "drums", c, 8000, 0, np.ones(3 + c)) for c in range(2)])
    assert batch.num_rows == 2 and batch.column("samples").to_pylist() == [[1.0] * 3, [1.0] * 4]
