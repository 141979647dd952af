"""Content and structure keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def content_key(*parts: Column) -> Column:
    """SHA-256 of parts joined by colons; the last is trimmed and lower-cased, order counts."""
    *fixed, prompt = parts
    return F.sha2(F.concat_ws(":", *fixed, F.lower(F.trim(prompt))), 256)


def structure_key(sections: Column) -> Column:
    """MD5 of array<struct<label, start_beat, end_beat, transition_in, stem_gains map>>, gains in steps of 0.2.

    Two plans of one key have the same labels, boundaries, transitions and roughly the same gains.
    """

    def one(s: Column) -> Column:
        gains = F.transform(F.array_sort(F.map_entries(s["stem_gains"])), lambda e: F.concat_ws("=", e["key"], F.rint(e["value"] / 0.2).cast("int").cast("string")))
        return F.concat_ws("|", s["label"], F.concat_ws("-", s["start_beat"].cast("string"), s["end_beat"].cast("string")), s["transition_in"], F.concat_ws(",", gains))

    return F.md5(F.concat_ws("||", F.transform(sections, one)))


def record_id(name: Column, namespace_hex: str = "6ba7b8119dad11d180b400c04fd430c8") -> Column:
    """Name-based UUID, version 5, of a URL by default."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def state_key(kind: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), *parts)


def palette(url: Column) -> Column:
    """struct of four colours and a variant 0 to 2 that a URL's hash stands for."""
    digest = F.sha2(url, 256)
    colours = [F.concat(F.lit("#"), F.substring(digest, 1 + 6 * k, 6)).alias(f"c{k}") for k in range(4)]
    return F.struct(*colours, (F.conv(F.substring(digest, 25, 2), 16, 10).cast("int") % 3).alias("variant"))
