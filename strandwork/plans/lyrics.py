"""Lyrics of songs: who sings what, where its text is, and its lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strandwork.functions import text

#: Lines of a song that are kept, evenly from first to last.
MOST_LINES = 60


def looked_up(songs: DataFrame, song: str, name: Column, tag_artist: Column, tag_title: Column, lyrics: DataFrame, most: int = MOST_LINES) -> DataFrame:
    """(song, artist, title, source, is_synced, lines, raw_text) of songs whose lyrics are found and have lines.

    A song is known by its file name, else by its tags, else by its cleaned name. `lyrics` has one row of (query, text) for each
    `artist title`. Text with a time stamp anywhere is timed: its lines stand by time, and those without a stamp are no
    lines. Other text gives its lines in order, without times.
    """
    who = songs.select(song, text.identity(name, tag_artist, tag_title).alias("_i")).where("_i is not null").select(song, "_i.*")
    found = who.withColumn("query", F.trim(F.concat_ws(" ", "artist", "title"))).join(lyrics.select("query", F.col("text").alias("raw_text")), "query")
    timed = F.col("raw_text").rlike(r"\[\d{1,2}:\d{2}")
    plain = F.transform(text.plain_lines(F.col("raw_text")), lambda x: F.struct(x.alias("text"), F.lit(None).cast("double").alias("seconds")))
    lines = F.when(timed, text.lyric_lines(F.col("raw_text"))).otherwise(plain)
    once = F.explode(F.array(lines)).alias("lines")  # keeps the optimizer from parsing a text again for each line that is taken
    out = found.select("*", timed.alias("is_synced"), once).where(F.size("lines") > 0)
    return out.select(song, "artist", "title", "source", "is_synced", text.even_sample(F.col("lines"), most).alias("lines"), "raw_text")
