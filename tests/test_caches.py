"""Caches, shelves and lyrics at their edges, against plain rules."""

import datetime

from pyspark.sql import functions as F

from strandwork.plans import lyrics
from strandwork.sources import caches, documents, sinks


def blobs(spark, *rows):
    return spark.createDataFrame([(k, m, None if b is None else bytearray(b)) for k, m, b in rows], "key string, modified long, content binary")


def test_cache_replaces_evicts_and_forgets(spark, tmp_path):
    cache = caches.BlobCache(spark, f"file://{tmp_path}/c", 10)
    assert cache.entries() is None and cache.aliases() is None
    cache.sweep()
    cache.put_aliases(spark.createDataFrame([("u", "a")], "alias string, key string"))
    assert cache.aliases() is None
    cache.put(blobs(spark, ("a", 1, b"aaaa"), ("a", 0, b"old"), ("b", 2, b"bbbb"), ("empty", 3, b""), ("none", 3, None), (None, 3, b"x")))
    ask = lambda *keys: {r["q"]: bytes(r["content"]) for r in cache.get(spark.createDataFrame([(k,) for k in keys], "q string"), "q").collect()}
    assert ask("a", "b", "empty", "none", "c") == {"a": b"aaaa", "b": b"bbbb"}
    cache.put_aliases(spark.createDataFrame([("u", "b"), ("u", "a"), ("a", "b"), ("v", "c"), ("w", "b")], "alias string, key string"))
    cache.put_aliases(spark.createDataFrame([("u", "b")], "alias string, key string"))
    assert ask("u", "v", "w", "a") == {"u": b"aaaa", "w": b"bbbb", "a": b"aaaa"}
    cache.put(blobs(spark, ("c", 9, b"cccccc")), spark.createDataFrame([("a",), ("a",)], "key string"))
    assert ask("a", "b", "c", "u", "w") == {"a": b"aaaa", "c": b"cccccc", "u": b"aaaa"}
    cache.put(blobs(spark, ("big", 10, b"x" * 20)))
    cache.put(blobs(spark))
    assert ask("a", "b", "c", "big", "u") == {}, "nothing is protected any more, and one entry exceeds the cap"
    cache.put(blobs(spark, ("big", 10, b"y" * 20)))
    cache.sweep()
    assert ask("a", "big") == {"big": b"y" * 20} and len(sinks.children(spark, f"file://{tmp_path}/c/content")) == 1


def test_shelf_in_step_with_seeds(spark):
    base = datetime.datetime(2024, 1, 1)
    seeds = documents.seed_records([("s1", "T1", "A1"), ("s2", "T2", "A2")], base)
    shelves = {
        "empty": '{"records": []}',
        "full": '{"records": [{"youtube_url": "s2"}, {"youtube_url": "s1", "is_curated": true}]}',
        "stale": '{"records": [{"youtube_url": "x", "is_curated": true}, {"youtube_url": "x", "is_curated": false}, {"youtube_url": "y"}, {"title": "no link", "is_curated": true}, {"youtube_url": "s2"}]}',
        "broken": '{"records": [',
        "none": '{"records": 7}',
    }
    rows = spark.createDataFrame(list(shelves.items()), "k string, json string")
    out = {r["k"]: r["s"] for r in rows.select("k", documents.in_step(documents.decoded(F.col("json"), documents.SHELF)["records"], seeds).alias("s")).collect()}
    links = lambda k: [r["youtube_url"] for r in out[k]["records"]]
    assert links("empty") == ["s1", "s2"] and out["empty"]["changed"]
    assert links("full") == ["s2", "s1"] and not out["full"]["changed"]
    assert links("stale") == ["y", None, "s2", "s1"] and out["stale"]["changed"]
    assert out["broken"] is None and out["none"] is None
    table = documents.seeds(spark, [("s1", "T1", "A1"), ("s2", "T2", "A2")], "2024-01-01 00:00:00").collect()
    assert [(r["id"], r["title"], r["artist"], r["added_at"]) for r in table] == [(r["id"], r["title"], r["artist"], r["added_at"]) for r in out["empty"]["records"]]


def test_shelves_are_parsed_once_and_brought_in_step_once(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    seeds = documents.seed_records([("s1", "T1", "A1")], datetime.datetime(2024, 1, 1))
    rows = documents.with_decoded(spark.createDataFrame([("{}",)], "json string"), "json", documents.SHELF)
    assert plan(rows.select(documents.in_step(F.col("doc.records"), seeds))).count("from_json") == 1
    many = plan(spark.createDataFrame([("{}",)], "json string").select(documents.in_step(documents.decoded(F.col("json"), documents.SHELF)["records"], seeds)))
    assert many.count("from_json") <= 2


def test_sets_are_published_whole(spark):
    table = lambda *r: spark.createDataFrame(list(r), "k int, name string, v int")
    current = table((1, "a", 0), (2, "a", 0), (3, "z", 0), (4, "a", 0))
    staged = table((1, "a", 1), (1, "b", 1), (2, "a", 1), (3, "a", 1), (3, "b", 1), (3, "c", 1), (4, "a", 1), (4, None, 1), (5, "a", 1), (5, "b", 1))
    out = caches.published(current, staged, ["k"], "name", ["a", "b"])
    assert sorted(map(tuple, out.collect())) == [(1, "a", 1), (1, "b", 1), (2, "a", 0), (3, "z", 0), (4, "a", 0), (5, "a", 1), (5, "b", 1)]
    assert caches.published(current, staged.where("false"), ["k"], "name", ["a", "b"]).count() == 4


def test_lyrics_are_looked_up_by_what_is_known(spark):
    songs = spark.createDataFrame([(1, "A - B.mp3", "", ""), (2, "x_y.wav", "T", "U"), (3, "x_y.wav", "", ""), (4, "C - D.mp3", "", ""), (5, "E - F.mp3", "", ""), (6, "G - H.mp3", "", "")], "id int, name string, a string, t string")
    texts = spark.createDataFrame([("A B", "[00:09.5]late\n[ar: no]\nunstamped\n[00:01]early"), ("T U", "one\n\n two "), ("x y", "\n".join(map(str, range(200)))), ("C D", ""), ("E F", "[00:01]\n[00:02] ")], "query string, text string")
    out = {r["id"]: r for r in lyrics.looked_up(songs, "id", F.col("name"), F.col("a"), F.col("t"), texts).collect()}
    assert sorted(out) == [1, 2, 3]
    assert [tuple(x) for x in out[1]["lines"]] == [("early", 1.0), ("late", 9.5)] and out[1]["is_synced"] and out[1]["source"] == "filename"
    assert [tuple(x) for x in out[2]["lines"]] == [("one", None), ("two", None)] and (out[2]["artist"], out[2]["source"]) == ("T", "tags")
    assert [x["text"] for x in out[3]["lines"]] == [str(k * 199 // 59) for k in range(60)] and out[3]["source"] == "stem"
