"""URL rules as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from strandwork.functions.rules import first_match

#: Hosts that links may have.
VIDEO_HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com", "youtu.be", "music.youtube.com")
IMAGE_HOSTS = ("i.ytimg.com", "img.youtube.com")


def part(url: Column, what: str, key: str | None = None) -> Column:
    """A part of a URL, null where it has none or cannot be parsed."""
    return F.try_parse_url(url, F.lit(what), F.lit(key)) if key else F.try_parse_url(url, F.lit(what))


def scheme(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1), F.lit("")))


def authority(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit(""))


def host(url: Column) -> Column:
    """Lower-case host of an authority without user and port; brackets of IPv6 are kept."""
    return F.lower(F.nullif(F.regexp_extract(authority(url), r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1), F.lit("")))


def port(url: Column) -> Column:
    return F.nullif(F.regexp_extract(authority(url), r":(\d+)$", 1), F.lit("")).cast("int")


def verdict(url: Column, hosts: tuple[str, ...] = VIDEO_HOSTS) -> Column:
    """`ok`, or the first rule that a link breaks: scheme, user, host, ip, port, unknown host."""
    h = host(url)
    address = h.startswith("[") | h.rlike(r"^\d*(?:\.\d*)*$")
    return first_match(
        [
            (url.isNull() | ~F.coalesce(scheme(url) == "https", F.lit(False)), "scheme"),
            (F.contains(F.coalesce(authority(url), F.lit("")), F.lit("@")), "user"),
            (h.isNull(), "host"),
            (address, "ip"),
            (F.coalesce(port(url) != 443, F.lit(False)), "port"),
            (~h.isin(*hosts), "unknown host"),
        ],
        "ok",
    )


def image_verdict(url: Column, hosts: tuple[str, ...] = IMAGE_HOSTS, longest: int = 500) -> Column:
    """HTTP status of a request for an image link: 400 too long or missing, 403 not allowed, 200 fine."""
    allowed = F.coalesce(scheme(url).isin("http", "https") & host(url).isin(*hosts), F.lit(False))
    return first_match([(url.isNull() | (F.length(url) > longest), 400), (~allowed, 403)], 200)


def _steps(url: Column) -> Column:
    return F.filter(F.split(F.coalesce(F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), F.lit("")), "/"), lambda x: x != "")


def query_value(url: Column, key: str) -> Column:
    """First non-empty value of a query key."""
    return F.nullif(F.regexp_extract(url, rf"^[^#?]*\?(?:[^#]*&)?{key}=([^&#]+)", 1), F.lit(""))


def video_id(url: Column) -> Column:
    """From the short host's path, else the `v` key, else a shorts or embed path."""
    steps, first = _steps(url), F.get(_steps(url), F.lit(0))
    return F.coalesce(F.when(host(url) == "youtu.be", first), query_value(url, "v"), F.when(first.isin("shorts", "embed"), F.get(steps, F.lit(1))))


def thumbnail(url: Column) -> Column:
    return F.concat(F.lit("https://i.ytimg.com/vi/"), video_id(url), F.lit("/hqdefault.jpg"))


def normalized(url: Column) -> Column:
    """One spelling of a link: the watch page of its video, else without fragment and last slash, keys sorted."""
    path = F.regexp_replace(F.regexp_extract(url, r"^([^?#]*)", 1), r"/+$", "")
    query = F.array_join(F.array_sort(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&")), "&")
    plain = F.when(query == "", path).otherwise(F.concat(path, F.lit("?"), query))
    known = host(url).isin(*VIDEO_HOSTS)
    return F.coalesce(F.when(known, F.concat(F.lit("https://www.youtube.com/watch?v="), video_id(url))), plain)


def is_phone(text: Column) -> Column:
    return text.rlike(r"^\+[1-9]\d{1,14}$")


def is_uuid(text: Column) -> Column:
    return text.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^/.](\.[^./]+)$", 1))
