"""Small decision rules as columns: first match wins, everything else falls through to a default."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, functions as F


def first_match(rules: Iterable[tuple[Column, object]], default: object = None) -> Column:
    """CASE WHEN over (condition, value) pairs; values may be columns."""
    chain = None
    for condition, value in rules:
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return F.lit(default) if chain is None else chain.otherwise(default)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is named: the one entry of an array is transformed."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lookup(key: Column, table: Mapping, default: object = None) -> Column:
    """Value of a literal map, or the default where the key is missing or null."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = F.try_element_at(pairs, key)
    return F.coalesce(found, F.lit(default)) if default is not None else found


def has_any(text: Column, words: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def has_with(text: Column, word: str, others: Iterable[str]) -> Column:
    return F.contains(text, F.lit(word)) & has_any(text, others)


# --- failures of a remote source -------------------------------------------------------------------------------------
#: Fixed vocabularies of failure messages: what no retry clears, and what one may.
GONE = ("video unavailable", "is not available", "has been removed", "private video", "this video is private", "removed by the user", "account associated", "terminated")
NO_TRACK = ("no audio", "no suitable", "requested format")
ELSEWHERE = ("not available in your", "not available in the server", "geo", "country", "region")
PASSING = ("403", "forbidden", "429", "too many", "throttl", "rate", "timed out", "timeout", "temporarily", "connection", "network", "urlopen", "resolve")
AGE = ("restrict", "gate", "confirm")


def error_class(status: Column, detail: Column) -> Column:
    """`permanent` or `transient`: permanent words, then transient words, then the status, then permanent."""
    m = F.lower(F.coalesce(detail, F.lit("")))
    lasting = has_with(m, "live", ("stream", "event")) | has_any(m, GONE) | has_with(m, "age", AGE) | has_any(m, NO_TRACK) | has_any(m, ELSEWHERE)
    retry = (status >= 500) | status.isin(429, 400)
    return first_match([(lasting, "permanent"), (has_any(m, PASSING), "transient"), (retry, "transient")], "permanent")


def error_topic(detail: Column) -> Column:
    """What a failure message is about, the most specific topic first."""
    m = F.lower(F.coalesce(detail, F.lit("")))
    return first_match(
        [
            (has_with(m, "live", ("stream", "event")), "live"),
            (has_any(m, ("video unavailable", "is not available")), "unavailable"),
            (has_with(m, "age", AGE), "age"),
            (has_any(m, ("geo", "country", "region", "not available in your", "blocked")), "region"),
            (has_any(m, NO_TRACK), "no audio"),
            (has_any(m, ("429", "too many", "rate")), "throttled"),
            (has_any(m, ("urlopen", "connection", "network", "timed out", "resolve")), "network"),
        ],
        "other",
    )


def separation_error(kind: Column) -> Column:
    """Invalid output is lasting; a full disk and everything else may pass."""
    return F.when(kind == "ValueError", "invalid_input").otherwise("transient")


# --- lifecycle ---------------------------------------------------------------------------------------------------------
def expired(status: Column, age_s: Column, ttl_s: float = 3 * 3600, processing_s: float = 20 * 60, queued_s: float = 150 * 60) -> Column:
    """Whether a session is purged: those at work or queued at their limit, all others beyond the common one."""
    return first_match([(status == "processing", age_s >= processing_s), (status == "queued", age_s >= queued_s)], age_s > ttl_s)


def public_state(exists: Column, is_expired: Column, status: Column) -> Column:
    """What the public sees of a session: missing, then expired, then complete, then in flight, then error."""
    return first_match(
        [(~exists | exists.isNull(), "not_found"), (is_expired, "expired"), (status == "complete", "ready"), (status.isin("queued", "processing"), "processing")],
        "error",
    )


def queue_action(is_expired: Column, cancelled: Column, connected: Column) -> Column:
    """What to do with the head of a queue."""
    return first_match([(is_expired, "drop_expired"), (cancelled, "drop_cancelled"), (~connected, "drop_abandoned")], "start")


def retry_delay(code: Column, attempt: Column, base: float = 30, cap: float = 600, fixed_code: str = "invalid_input", fixed: float = 600) -> Column:
    """Seconds before a retry: fixed for one code, else doubling up to a cap. Jitter is the caller's: half to all of it."""
    return F.when(code == fixed_code, F.lit(float(fixed))).otherwise(F.least(F.lit(float(cap)), base * F.pow(F.lit(2.0), attempt - 1)))


def error_event(detail: Column, code: Column | None = None, song: Column | None = None) -> Column:
    """JSON of a terminal error event; what is not known is left out."""
    optional = {"code": code, "song": song}
    fields = [F.lit("error").alias("step"), detail.alias("detail"), F.lit(0).alias("progress"), *[c.alias(n) for n, c in optional.items() if c is not None]]
    return F.to_json(F.struct(*fields))


# --- flags ---------------------------------------------------------------------------------------------------------------
def flags(rules: Iterable[tuple[Column, object]]) -> Column:
    """Array of the names whose condition holds, in order, each once."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(v) if isinstance(v, str) else v) for c, v in rules])))


#: Limits of a run's red flags.
LONG_INTRO, LONG_SONG, HIGH_STRETCH, HIGH_SHIFT, BORDERLINE, GHOST, MISMATCH = 16, 120.0, 25.0, 3, (-50.0, -35.0), 0.01, 0.10


def run_flags(c) -> Column:
    """Red flags of a run; `c` gives its columns by name.

    intro_beats, start_b, duration_b, stretch_pct, inst_semitones, grid, lufs (map), rms (map), active (array), rendered, estimated.
    """
    borderline = F.exists(F.map_values(c("lufs")), lambda x: x.between(*BORDERLINE))
    ghost = F.exists(F.array(F.lit("guitar"), F.lit("piano")), lambda s: (F.try_element_at(c("rms"), s) < GHOST) & F.array_contains(c("active"), s))
    return flags(
        [
            (c("intro_beats") > LONG_INTRO, "long_intro"),
            ((c("start_b") == 0) & (c("duration_b") > LONG_SONG), "zero_start_instrumental"),
            (c("stretch_pct") > HIGH_STRETCH, F.concat(F.lit("high_stretch_"), F.rint(c("stretch_pct")).cast("long"), F.lit("%"))),
            (F.abs(c("inst_semitones")) > HIGH_SHIFT, "high_key_shift"),
            (c("grid") == "scaled_fallback", "beat_grid_fallback"),
            (borderline, "borderline_stem"),
            (ghost, "ghost_stem"),
            ((c("rendered") > 0) & duration_mismatch(c("rendered"), c("estimated"), MISMATCH), "duration_mismatch"),
        ]
    )


def duration_mismatch(actual: Column, expected: Column, limit: float) -> Column:
    """Relative difference beyond a limit; null or zero expectations never mismatch."""
    return F.coalesce(F.try_divide(F.abs(actual - expected), expected) > limit, F.lit(False))


def silent(energy: Column, active: Column) -> Column:
    """No bar with energy and no active bar; null arrays are not degenerate, empty ones are."""
    return F.coalesce(~F.exists(energy, lambda x: x != 0) & ~F.exists(active, lambda x: x), F.lit(False))


def fold_warnings(warnings: Column, handled: Iterable[str], note: Column) -> Column:
    """Drop warnings that contain a handled phrase, append a note where there is one; order kept, each once."""
    kept = F.filter(warnings, lambda w: ~has_any(w, handled))
    return F.array_distinct(F.when(note.isNotNull(), F.array_append(kept, note)).otherwise(kept))
