"""Times of log records as columns. The session's zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parsed(raw: Column) -> Column:
    """A timestamp of ISO text, or of `yyyy-MM-dd HH:mm:ss,SSS`; times without an offset are UTC, others null."""
    return F.coalesce(F.try_to_timestamp(raw), F.try_to_timestamp(raw, F.lit("yyyy-MM-dd HH:mm:ss,SSS")))


def day_text(raw: Column) -> Column:
    """The date that a record's own text begins with, whatever its offset; null if that is no date."""
    return F.when(F.try_to_date(F.substring(raw, 1, 10)).isNotNull(), F.substring(raw, 1, 10))


def iso_week(date: Column) -> Column:
    """YYYY-Www of the ISO calendar."""
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), date), F.weekofyear(date))


def since(days: int | None, now: Column) -> Column | None:
    """The earliest time of a report over so many days, or None for all."""
    if days is None:
        return None
    if not 1 <= days <= 365:
        raise ValueError("days must be from 1 to 365")
    return now - F.make_dt_interval(days=F.lit(days))


def age_seconds(then: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(then)) / 1e6
