"""Queries over tables that Spark writes to the shared folder and reads back: shelves, caches, documents, logs; the catalogue registers them."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import SparkSession, functions as F

from strandwork.operators import scans
from strandwork.plans import lyrics
from strandwork.plans.catalogue import EVENTS_A_TASK, NOW, c, query
from strandwork.sources import caches, documents as docs, files, logs, sinks


def _folder(spark: SparkSession, name: str) -> str:
    return f"{sinks.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


LINK = "https://x.example/"
#: Lines that one task joins or sorts.
LINES_A_TASK = 500_000


@query(
    """WITH r AS (SELECT l_orderkey, l_partkey % 10 AS u, l_returnflag = 'R' AS cur, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey % 10, l_returnflag = 'R') AS i FROM lineitem WHERE l_orderkey % 13 <> 0),
    stale AS (SELECT DISTINCT l_orderkey, u FROM r WHERE cur AND u % 2 = 1), wanted AS (SELECT DISTINCT l_orderkey, unnest([0, 2, 4, 6, 8, 10, 12]) AS u FROM r),
    every AS (SELECT l_orderkey, 0 AS g, i, u, cur, NULL AS added_at FROM r ANTI JOIN stale USING (l_orderkey, u)
      UNION ALL SELECT l_orderkey, 1, u, u, true, strftime(TIMESTAMP '2024-01-31' - to_minutes(u // 2), '%Y-%m-%dT%H:%M:%S+00:00') FROM wanted ANTI JOIN r USING (l_orderkey, u))
    SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY g, i) - 1)::INTEGER AS place, 'https://x.example/' || u AS youtube_url, cur AS is_curated, added_at FROM every"""
)
def shelf_sync(t):
    """Orders as shelf documents, some of them broken: written, read back, brought in step with seven seeds, swapped in for the old ones, and read again."""
    lines = t("lineitem")
    spark = lines.sparkSession
    path = _folder(spark, "shelves")
    entry = F.struct("l_linenumber", (c("l_partkey") % 10).alias("u"), (c("l_returnflag") == "R").alias("cur"))
    shelves = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(entry)).alias("r"))
    shelves = shelves.select("l_orderkey", F.to_json(F.struct(F.transform("r", lambda e: F.struct(F.concat(F.lit(LINK), e["u"]).alias("youtube_url"), e["cur"].alias("is_curated"))).alias("records"))).alias("json"))
    sinks.replace_table(shelves.withColumn("json", F.when(c("l_orderkey") % 13 == 0, F.expr("left(json, 9)")).otherwise(c("json"))), path)
    seeds = docs.seed_records([(f"{LINK}{2 * k}", f"Title {k}", f"Artist {k}") for k in range(7)], datetime.datetime.fromisoformat(NOW))
    read = docs.with_decoded(spark.read.parquet(path), "json", docs.SHELF)
    stepped = read.withColumn("s", F.explode(F.array(docs.in_step(c("doc.records"), seeds))))  # once, for both columns that read it
    synced = stepped.select("l_orderkey", F.when(c("s.changed"), F.to_json(F.struct("s.records"))).otherwise(c("json")).alias("json"))
    sinks.replace_table(synced, path, lambda staged: staged.where("json is null").isEmpty())
    held = docs.with_decoded(spark.read.parquet(path), "json", docs.SHELF)
    records = held.select("l_orderkey", F.posexplode("doc.records").alias("place", "r"))
    return records.select("l_orderkey", "place", "r.youtube_url", "r.is_curated", "r.added_at")


@query(
    """WITH d AS (SELECT doc_id, strlen(text) AS n, md5(text) AS digest FROM documents WHERE strlen(text) > 0), two AS (SELECT *, doc_id % 3 = 0 AS again, doc_id % 3 = 0 OR doc_id % 10 = 4 AS safe FROM d WHERE doc_id % 3 = 0 OR doc_id % 2 = 0),
    run AS (SELECT *, sum(n) OVER () - coalesce(sum(CASE WHEN safe THEN 0 ELSE n END) OVER (ORDER BY again, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM two)
    SELECT doc_id, n AS size, digest FROM run WHERE (safe OR rest <= (SELECT sum(n) // 2 FROM d)) AND (doc_id % 5 >= 2 OR doc_id % 2 = 0)"""
)
def blob_cache(t):
    """Texts as bytes in a cache of half their size: two puts, the second with keys in flight, and aliases between them; then all are asked for, some by alias."""
    texts = t("documents").select("doc_id", F.concat(F.lit("c"), "doc_id").alias("key"), F.concat(F.lit("u"), "doc_id").alias("alias"), "text")
    spark = texts.sparkSession
    half = (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 2
    cache = caches.BlobCache(spark, _folder(spark, "blobs"), half)
    blobs = texts.select("doc_id", "key", c("doc_id").alias("modified"), F.encode("text", "utf-8").alias("content"))
    cache.put(blobs.where("doc_id % 2 = 0"))
    cache.put_aliases(texts.where("doc_id % 5 < 2").select("alias", "key"))
    cache.put(blobs.where("doc_id % 3 = 0").withColumn("modified", c("doc_id") + (1 << 40)), texts.where("doc_id % 10 = 4").select("key"))
    cache.sweep()
    asked = texts.select("doc_id", F.when(c("doc_id") % 5 < 2, c("alias")).otherwise(c("key")).alias("request"))
    return cache.get(asked, "request").select("doc_id", "size", F.md5("content").alias("digest"))


@query(
    """WITH ok AS (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1 HAVING bool_and(l_returnflag IN ('A', 'N')) AND count(DISTINCT l_returnflag) = 2)
    SELECT l_orderkey, l_returnflag, l_linestatus, count(*) AS n, sum(l_linenumber)::BIGINT AS lines FROM (SELECT * FROM lineitem WHERE l_linestatus = 'O' AND l_orderkey NOT IN (FROM ok) UNION ALL SELECT * FROM lineitem WHERE l_linestatus = 'F' AND l_orderkey IN (FROM ok)) GROUP BY 1, 2, 3"""
)
def stem_publication(t):
    """Open lines are an order's current stems, filled ones are staged; those with just the wanted names are swapped in."""
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    path = _folder(lines.sparkSession, "stems")
    sinks.replace_table(lines.where("l_linestatus = 'O'"), path)
    read = lines.sparkSession.read.parquet(path)
    n = scans.shares(lines, LINES_A_TASK)
    staged = lines.where("l_linestatus = 'F'").repartition(n, "l_orderkey")
    sinks.replace_table(caches.published(read.repartition(n, "l_orderkey"), staged, ["l_orderkey"], "l_returnflag", ["A", "N"]), path)
    held = lines.sparkSession.read.parquet(path).repartition(n, "l_orderkey")
    return held.groupBy("l_orderkey", "l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"))


@query(
    """WITH l AS (SELECT *, row_number() OVER w - 1 AS i, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS bar FROM lineitem WHERE l_orderkey % 11 <> 0 WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity))
    SELECT l_orderkey, 'bar' AS kind, l_returnflag AS name, bar::INTEGER AS place, l_quantity AS value FROM l
    UNION ALL SELECT l_orderkey, 'section', l_linestatus || l_suppkey % 3, i::INTEGER, l_partkey / 2 FROM l UNION ALL SELECT l_orderkey, 'word', 'w' || l_suppkey, i::INTEGER, l_partkey * 10 FROM l"""
)
def song_documents(t):
    """Orders as song documents of the full schema, a part of them broken: checkpointed twice, a part the first time, and read back as bars, sections and words."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    orders = t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("l"))
    flags = F.array_distinct(F.transform("l", lambda x: x["l_returnflag"]))
    bars = F.map_from_arrays(flags, F.transform(flags, lambda f: F.transform(F.filter("l", lambda x: x["l_returnflag"] == f), lambda x: x["l_quantity"])))
    section = lambda x, i: F.struct(i.alias("start_bar"), (i + 1).alias("end_bar"), (x["l_partkey"] / 2).alias("start_time"), F.concat(x["l_linestatus"], (x["l_suppkey"] % 3).cast("string")).alias("label"), F.array(F.lit("n")).alias("annotations"))
    word = lambda x: F.struct((x["l_partkey"] * 10).alias("start_ms"), F.concat(F.lit("w"), x["l_suppkey"].cast("string")).alias("text"))
    song = F.struct(
        F.lit(120.0).alias("bpm"), F.size("l").alias("total_beats"), F.struct(bars.alias("bar_rms")).alias("stem_analysis"),
        F.struct(F.transform("l", section).alias("sections"), F.size("l").alias("total_bars")).alias("song_structure"), F.struct(F.transform("l", word).alias("words"), F.lit("s").alias("source")).alias("word_alignment"),
    )
    text = docs.encoded(song)
    rows = orders.select("l_orderkey", F.when(c("l_orderkey") % 11 == 0, F.substring(text, 1, 40)).otherwise(text).alias("json"))
    path = _folder(rows.sparkSession, "songs")
    sinks.append_absent(rows.where("l_orderkey % 2 = 0"), path, "l_orderkey")
    sinks.append_absent(rows, path, "l_orderkey")
    songs = docs.with_decoded(rows.sparkSession.read.parquet(path), "json", docs.SONG).where("doc is not null")
    held = songs.select("l_orderkey", F.explode(docs.facts()).alias("f")).where((c("f.kind") != "section") | (F.get("f.annotations", F.lit(0)) == "n"))
    return held.select("l_orderkey", "f.kind", "f.name", "f.place", "f.value")


@query(
    """WITH d AS (SELECT doc_id, lang, list_transform(string_split_regex(text, '\\r\\n|\\n|\\r| '), lambda x: trim(x, ' ')) AS l FROM documents WHERE doc_id % 4 <> 3),
    s AS (SELECT doc_id, lang, list_filter(list_transform(l, lambda x, i: {'s': CASE WHEN lang = 'en' THEN ((i - 1) // 60 % 100 * 60 + (i - 1) % 60)::DOUBLE END, 'i': i, 'x': x}), lambda e: e.x <> '') AS l FROM d),
    o AS (SELECT doc_id, lang, CASE WHEN lang = 'en' THEN list_sort(l) ELSE l END AS l FROM s WHERE len(l) > 0), k AS (SELECT doc_id, lang, CASE WHEN len(l) <= 60 THEN l ELSE list_transform(range(60), lambda j: l[(j * (len(l) - 1)) // 59 + 1]) END AS l FROM o)
    SELECT doc_id, CASE lang WHEN 'en' THEN 'filename' WHEN 'de' THEN 'tags' ELSE 'stem' END AS source, lang = 'en' AS is_synced, len(l)::INTEGER AS n, list_sum(list_transform(l, lambda e: e.s)) AS seconds, md5(array_to_string(list_transform(l, lambda e: e.x), chr(10))) AS digest FROM k"""
)
def lyric_lookup(t):
    """Documents as songs known by name, tags or cleaned name, and as their own lyrics: words as lines, English ones with times; every fourth has none."""
    rows = t("documents")
    number = c("doc_id").cast("string")
    name = F.when(c("lang") == "en", F.concat(F.lit("x/Singer "), number, F.lit(" - Song.mp3"))).otherwise(F.concat(F.lit("tune_"), number, F.lit(".flac")))
    german = c("lang") == "de"
    wanted = F.when(c("lang") == "en", F.concat(F.lit("Singer "), number, F.lit(" Song"))).when(german, F.concat(F.lit("Tagged "), number)).otherwise(F.concat(F.lit("tune "), number))
    stamp = lambda i: F.format_string("[%02d:%02d.00]", F.floor(i / 60).cast("int") % 100, i % 60)
    words = F.split("text", r"\r\n|\n|\r| ")
    text = F.array_join(F.when(c("lang") == "en", F.transform(words, lambda x, i: F.concat(stamp(i), x))).otherwise(words), "\n")
    found = lyrics.looked_up(rows, "doc_id", name, F.when(german, "Tagged").otherwise(""), F.when(german, number).otherwise(""), rows.where("doc_id % 4 <> 3").select(wanted.alias("query"), text.alias("text")))
    times = F.when(c("is_synced"), F.aggregate("lines", F.lit(0.0), lambda a, x: a + x["seconds"]))
    return found.select("doc_id", "source", "is_synced", F.size("lines").alias("n"), times.alias("seconds"), F.md5(F.array_join(F.transform("lines", lambda x: x["text"]), "\n")).alias("digest"))


@query(
    """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS level, count(*) AS n, count(took_s) AS timed, round(sum(took_s), 4) AS took_s, round(sum(ratio), 4) AS ratio FROM (SELECT ts, event_type, CASE WHEN event_type <> 'view' THEN round_even(value, 1) END AS took_s, round_even(value / 7, 3) AS ratio FROM events) GROUP BY ALL"""
)
def step_log(t):
    """Events as steps that are logged with rounded fields in files of bounded length, then scanned as any log."""
    events = t("events")
    path = _folder(events.sparkSession, "log")
    rows = events.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("asctime"), c("event_type").alias("levelname"), F.when(c("event_type") != "view", c("value")).alias("took_s"), (c("value") / 7).alias("ratio"))
    sinks.write_log(sinks.log_lines(rows, {"took_s": 1, "ratio": 3}), path, 10_000)
    read = logs.dated(logs.records(logs.lines(events.sparkSession, path)))
    field = lambda n, kind: F.try_variant_get("j", F.lit(f"$.{n}"), kind).alias(n)
    return read.select("day", field("level", "string"), field("took_s", "double"), field("ratio", "double")).groupBy("day", "level").agg(
        F.count(F.lit(1)).alias("n"), F.count("took_s").alias("timed"), F.round(F.sum("took_s"), 4).alias("took_s"), F.round(F.sum("ratio"), 4).alias("ratio"))


def stem_folder(t) -> str:
    """A new folder of WAV files: users as videos of two roles, types of events as stems, values as samples, each 64 times."""
    e = t("events").select("user_id", "event_type", F.struct("ts", "event_id", "value").alias("e"))
    e = e.repartition(scans.shares(e, EVENTS_A_TASK), "user_id", "event_type")
    rows = e.groupBy("user_id", "event_type").agg(F.flatten(F.transform(F.sort_array(F.collect_list("e")), lambda x: F.array_repeat((x["value"] / 1024).cast("float"), 64))).alias("samples"))
    role = F.when(c("user_id") % 2 == 0, "vocal").otherwise("instrumental")
    path = _folder(e.sparkSession, "stems")
    files.write_stems(rows.select(F.concat(F.lit("v"), "user_id").alias("video_id"), role.alias("role"), c("event_type").alias("stem"), "samples"), path, 22050)
    return path


@query(
    """WITH s AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS manifest, bool_and(44 + n * 256 >= 1024) AS intact, round(sum(n * 64 / 22050), 9) AS seconds FROM s GROUP BY 1),
    complete AS (SELECT * FROM m WHERE intact AND manifest = 'click,error,purchase,signup,view'), odd AS (SELECT count(*) AS n FROM complete WHERE user_id % 2 = 1)
    SELECT 'v' || user_id AS video_id, CASE WHEN user_id % 2 = 0 THEN 'vocal' ELSE 'instrumental' END AS role, manifest, intact, seconds, CASE WHEN user_id % 2 = 0 AND user_id IN (SELECT user_id FROM complete) THEN (SELECT n FROM odd) ELSE 0 END AS ready FROM m"""
)
def stem_manifests(t):
    """Manifests of stem files by their headers alone, with their length, and with how many complete instrumental videos a complete vocal one is ready to meet."""
    path = stem_folder(t)
    spark = t("events").sparkSession
    headers = files.stem_headers(spark, path)
    manifest = files.manifests(headers)
    seconds = headers.groupBy("video_id", "role").agg(F.round(F.sum(files.duration_s(c("content"))), 9).alias("seconds"))
    names = F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))
    whole = manifest.where(c("intact") & (c("manifest") == names)).groupBy("role").agg(F.count(F.lit(1)).alias("n"))
    met = F.coalesce(whole.where("role = 'instrumental'").select("n").scalar(), F.lit(0))
    ready = F.when((c("role") == "vocal") & c("intact") & (c("manifest") == names), met).otherwise(0)
    return manifest.join(seconds, ["video_id", "role"]).select("video_id", "role", F.array_join("manifest", ",").alias("manifest"), "intact", "seconds", ready.cast("long").alias("ready"))


@query(
    """WITH s AS (SELECT user_id, event_type, (value / 1024)::FLOAT::DOUBLE AS x FROM events)
    SELECT 'v' || user_id AS video_id, event_type AS stem, unnest([0, 1])::INTEGER AS channel, count(*) * 64 AS n, round(sqrt(sum(x * x) / count(*)), 6) AS rms FROM s GROUP BY 1, 2"""
)
def stem_levels(t):
    """Levels of stem files, read in chunks, one channel doubled."""
    path = stem_folder(t)
    chunks = files.signal_chunks(files.stem_files(t("events").sparkSession, path), chunk=1000)
    sums = chunks.select("video_id", "stem", "channel", F.size("samples").alias("n"), F.aggregate("samples", F.lit(0.0), lambda a, x: a + x * x).alias("e"))
    return sums.groupBy("video_id", "stem", "channel").agg(F.sum("n").alias("n"), F.round(F.sqrt(F.sum("e") / F.sum("n")), 6).alias("rms"))
