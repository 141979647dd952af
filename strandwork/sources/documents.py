"""Nested song documents, lyrics, shelves and cache states as typed columns."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

GAP = "struct<start_bar:bigint,end_bar:bigint,length_bars:bigint>"
SECTION = "struct<start_bar:bigint,end_bar:bigint,bar_count:bigint,start_time:double,end_time:double,label:string,energy_level:string,energy_trajectory:string,density:string,vocal_status:string,vocal_prominence_db:double,annotations:array<string>,section_source:string>"
#: The song document; what an old document lacks is null.
SONG = (
    "struct<bpm:double,bpm_confidence:double,beat_frames:array<bigint>,duration_seconds:double,total_beats:bigint,beat_times:array<double>,downbeat_times:array<double>,"
    "key:string,scale:string,key_confidence:double,has_modulation:boolean,source_quality:string,mean_rms:double,"
    f"stem_analysis:struct<bar_rms:map<string,array<double>>,combined_energy:array<double>,vocal_active:array<boolean>,vocal_gaps:array<{GAP}>,bucket_thresholds:struct<noise_floor:double,p10:double,p50:double,p85:double>>,"
    f"song_structure:struct<sections:array<{SECTION}>,vocal_gaps:array<{GAP}>,total_bars:bigint>,"
    "chord_progression:struct<chords:array<struct<start_ms:bigint,end_ms:bigint,chord:string>>,unique_chords:array<string>,most_common_chord:string,progression_summary:string>,"
    "polyphony_info:struct<polyphonic:boolean,method:string,gate1_ratio:double,gate2_ratio:double>,"
    "drum_pattern:struct<kick_count:bigint,snare_count:bigint,hihat_count:bigint,total_hits:bigint,duration_ms:bigint,style_hint:string>,"
    "word_alignment:struct<words:array<struct<start_ms:bigint,text:string,end:bigint>>,source:string,lrclib_validated:boolean,lrclib_offset_ms:bigint>>"
)
LYRICS = "struct<artist:string,title:string,source:string,is_synced:boolean,lines:array<struct<text:string,timestamp_seconds:double>>,raw_text:string,lookup_duration_ms:double>"
SHELF = "struct<records:array<struct<id:string,youtube_url:string,title:string,artist:string,thumbnail_url:string,sleeve_image_url:string,added_at:string,is_curated:boolean>>>"
RECORD = ("id", "youtube_url", "title", "artist", "thumbnail_url", "sleeve_image_url", "added_at", "is_curated")
STATE = "struct<video_id:string,role:string,status:string,owner_token:string,started_at:string,updated_at:string,lease_expires_at:string,completed_at:string,failed_at:string,retry_after:string,attempt:int,path:string,manifest:array<string>>"


def decoded(text: Column, schema: str) -> Column:
    """A document of a schema; broken text is null."""
    return F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, schema, {"mode": "PERMISSIVE"}))


def with_decoded(rows: DataFrame, text: str, schema: str, name: str = "doc") -> DataFrame:
    """Rows with the document of a column of text, which is parsed once a row, however many later columns read it."""
    return rows.withColumn(name, F.explode(F.array(decoded(F.col(text), schema))))


def encoded(document: Column) -> Column:
    """JSON of a document without its null fields."""
    return F.to_json(document)


def exploded_bars(songs: DataFrame, song_id: str, document: str = "doc") -> DataFrame:
    """(song_id, stem, bar, rms): the fact table of a column of song documents."""
    stems = songs.select(song_id, F.explode(f"{document}.stem_analysis.bar_rms").alias("stem", "_r"))
    return stems.select(song_id, "stem", F.posexplode("_r").alias("bar", "rms"))


def exploded_sections(songs: DataFrame, song_id: str, document: str = "doc") -> DataFrame:
    return songs.select(song_id, F.posexplode(f"{document}.song_structure.sections").alias("idx", "_s")).select(song_id, "idx", "_s.*")


def facts(document: str = "doc") -> Column:
    """Array of (kind, name, place, value): the bars of a song document's stems, its sections (and their annotations) and its words,
    from one pass over it. What a document lacks gives none."""
    doc = F.col(document)
    kind = "array<struct<kind:string,name:string,place:int,value:double,annotations:array<string>>>"
    none = F.array().cast("array<string>")

    def some(found: Column) -> Column:
        return F.coalesce(found.cast(kind), F.array().cast(kind))

    stem = lambda e: F.coalesce(F.transform(e["value"], lambda rms, bar: F.struct(F.lit("bar"), e["key"], bar, rms, none)).cast(kind), F.array().cast(kind))
    bars = F.flatten(F.transform(F.map_entries(doc["stem_analysis"]["bar_rms"]), stem))
    sections = F.transform(doc["song_structure"]["sections"], lambda s, i: F.struct(F.lit("section"), s["label"], i, s["start_time"], s["annotations"]))
    words = F.transform(doc["word_alignment"]["words"], lambda w, i: F.struct(F.lit("word"), w["text"], i, w["start_ms"].cast("double"), none))
    return F.concat(some(bars), some(sections), some(words))


def shelf(spark: SparkSession, path: str) -> DataFrame:
    """Records of shelf documents, with their place."""
    docs = spark.read.text(path, wholetext=True).select(decoded(F.col("value"), SHELF).alias("d"))
    return docs.select(F.posexplode("d.records").alias("place", "r")).select("place", "r.*")


def seeds(spark: SparkSession, links: list[tuple[str, str, str]], base: str) -> DataFrame:
    """Curated shelf rows of (url, title, artist), one minute apart backwards from a base time."""
    rows = [(i, u, t, a, str(uuid.uuid5(uuid.NAMESPACE_URL, u))) for i, (u, t, a) in enumerate(links)]
    added = F.date_format(F.to_timestamp(F.lit(base)) - F.make_dt_interval(mins=F.col("place")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return spark.createDataFrame(rows, "place int, youtube_url string, title string, artist string, id string").select("id", "youtube_url", "title", "artist", added.alias("added_at"), F.lit(True).alias("is_curated"))


def seed_records(links: list[tuple[str, str, str]], base: datetime.datetime) -> Column:
    """The rows of `seeds` as one array of shelf records."""

    def one(i: int, link: tuple[str, str, str]) -> Column:
        url, title, artist = link
        known = {"id": str(uuid.uuid5(uuid.NAMESPACE_URL, url)), "youtube_url": url, "title": title, "artist": artist, "added_at": f"{base - datetime.timedelta(minutes=i):%Y-%m-%dT%H:%M:%S}+00:00", "is_curated": True}
        return F.struct(*[F.lit(known.get(n)).alias(n) for n in RECORD])

    return F.array(*[one(i, link) for i, link in enumerate(links)]).cast(SHELF[len("struct<records:") : -1])


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value that is computed once, also where it is used in lambdas, which compute their text for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def in_step(records: Column, seeds: Column) -> Column:
    """struct<records, changed>: a shelf without links of curated records that are no seeds, then the seeds that it lacks, in their order.

    A record without a link stays. A shelf that cannot be read (null) gives null. Lookups go through the shelf's own arrays, each made
    once, so time grows with its records times its stale links and the seeds.
    """
    link = lambda r: r["youtube_url"]
    among = lambda r, links: F.coalesce(F.array_contains(links, link(r)), F.lit(False))

    def stale(x: Column) -> Column:
        return F.array_distinct(F.transform(F.filter(x["records"], lambda r: F.coalesce(r["is_curated"], F.lit(False)) & ~among(r, x["wanted"])), link))

    def parted(x: Column, gone: Column) -> Column:
        kept, missing = F.filter(x["records"], lambda r: ~among(r, gone)), F.filter(seeds, lambda s: ~among(s, x["had"]))
        return F.struct(kept.alias("kept"), missing.alias("missing"), F.size(x["records"]).alias("n"))

    def joined(y: Column) -> Column:
        return F.struct(F.concat(y["kept"], y["missing"]).alias("records"), ((F.size(y["missing"]) > 0) | (F.size(y["kept"]) < y["n"])).alias("changed"))

    def stepped(held: Column) -> Column:
        links = F.struct(held.alias("records"), F.transform(seeds, link).alias("wanted"), F.transform(held, link).alias("had"))
        return F.when(held.isNotNull(), _once(links, lambda x: _once(_once(stale(x), lambda gone: parted(x, gone)), joined)))

    return _once(records, stepped)


def state_fields(state: Column) -> Column:
    """A cache state as the map of strings that stands on the wire: null fields are empty, lists are JSON."""
    names = [f.split(":")[0] for f in STATE[len("struct<") : -1].split(",")]
    text = {n: F.coalesce(F.to_json(state[n]) if n == "manifest" else state[n].cast("string"), F.lit("")) for n in names}
    return F.create_map(*[x for n in names for x in (F.lit(n), text[n])])


def state_of(fields: Column) -> Column:
    """The typed state of such a map; empty strings are null, a broken attempt is 0."""
    names = [f.split(":")[0] for f in STATE[len("struct<") : -1].split(",")]
    get = lambda n: F.nullif(F.try_element_at(fields, F.lit(n)), F.lit(""))
    typed = {"attempt": F.coalesce(F.try_to_number(get("attempt"), F.lit("999999999")).cast("int"), F.lit(0)), "manifest": F.coalesce(F.from_json(get("manifest"), "array<string>"), F.array().cast("array<string>"))}
    return F.struct(*[typed.get(n, get(n)).alias(n) for n in names])
