"""The operations dashboard over a log of runs: one tolerant scan, five aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from strandwork.functions.times import since
from strandwork.operators import aggregates as agg, filters
from strandwork.sources import logs

SONGS = ("a", "b")
#: Parts into which the most used songs are ranked before they meet in one order.
RANK_PARTS = 64


def _text(path: str) -> Column:
    return F.try_variant_get("j", F.lit(path), "string")


def runs(lines: DataFrame, now: Column, days: int | None = None) -> DataFrame:
    """Records of log lines (value, line) from a time on, as columns: `done` tells completed runs, `flags` may stand on any record."""
    rows = logs.dated(logs.records(lines, since=since(days, now)))
    return rows.select(
        "line", "day", "week", filters.is_completion(F.col("j")).alias("done"), filters.number_at(F.col("j"), "$.total_pipeline_time_s").alias("seconds"),
        *[_text(f"$.song_{s}_{f}").alias(f"{f}_{s}") for s in SONGS for f in ("video_id", "title")],
        *[F.try_variant_get("j", F.lit(f"$.song_{s}_cache_hit"), "boolean").alias(f"hit_{s}") for s in SONGS],
        filters.list_or_single(F.col("j"), "$.red_flags", "$.red_flag").alias("flags"),
    )


def parts(lines: DataFrame, now: Column, days: int | None = None, limit: int = 10) -> dict[str, DataFrame]:
    """The aggregates one by one: periods, average_time, most_used, flags, cache_hits."""
    rows = runs(lines, now, days)
    done = rows.where("done")
    return {
        "periods": agg.counts_by_period(done, "day", "week"),
        "average_time": done.agg(agg.rounded_mean(F.col("seconds")).alias("average_s")),
        "most_used": agg.top_pairs(done, [(f"video_id_{s}", f"title_{s}") for s in SONGS], "line", limit),
        "flags": agg.frequencies(rows, "flags", "line", ranked=True),
        "cache_hits": agg.hit_rate(done, "hit_a", "hit_b"),
    }


def report(lines: DataFrame, now: Column, days: int | None = None, limit: int = 10) -> DataFrame:
    """(metric, key, label, n, value, place) of all aggregates by one scan and one shuffle of partial counts.

    day, week, total: completed runs; time: their mean seconds; used: the `limit` most used songs in order; flag: red
    flags; hit_rate: cache hits in percent of slots, hits_a and hits_b their numbers. A record becomes the few facts
    that it is counted by; facts of one metric and key are counted together.
    """
    rows = runs(lines, now, days)
    text = lambda c: F.coalesce(c, F.lit("")).cast("string")
    none, all_ = F.lit(None).cast("double"), F.lit("all")

    def fact(metric: str, when: Column, key: Column, value: Column = none, label: Column = F.lit(""), slot: int = 0) -> Column:
        return F.when(when, F.struct(F.lit(metric).alias("metric"), text(key).alias("key"), text(label).alias("label"), value.cast("double").alias("value"), F.lit(slot).alias("slot")))

    done, dated = F.col("done"), F.col("done") & F.col("day").isNotNull()
    hits = [F.coalesce(F.col(f"hit_{s}"), F.lit(False)) for s in SONGS]
    known = done & (F.col("hit_a").isNotNull() | F.col("hit_b").isNotNull())
    used = [(F.col(f"video_id_{s}"), F.col(f"title_{s}")) for s in SONGS]
    facts = [
        fact("day", dated, F.col("day")), fact("week", dated, F.col("week")), fact("total", dated, all_), fact("time", done & F.col("seconds").isNotNull(), all_, F.col("seconds")),
        *[fact("used", done & ((text(i) != "") | (text(t) != "")), i, label=t, slot=k) for k, (i, t) in enumerate(used)],
        fact("hit_rate", known, all_, hits[0].cast("int") + hits[1].cast("int")), fact("hits_a", known & hits[0], all_), fact("hits_b", known & hits[1], all_),
    ]
    flagged = F.transform("flags", lambda f: fact("flag", F.lit(True), f))
    flat = rows.select("line", F.explode(F.array_compact(F.concat(F.array(*facts), flagged))).alias("f")).select("line", "f.*")
    counted = flat.groupBy("metric", "key", "label").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("line").alias("first"), F.min_by("slot", "line").alias("slot"))
    ranked = F.col("metric") == "used"
    order = [F.desc("n"), "first", "slot", "key", "label"]
    part = F.pmod(F.xxhash64("key", "label"), F.lit(RANK_PARTS))
    near = counted.withColumn("place", F.row_number().over(Window.partitionBy("metric", part).orderBy(*order))).where(~ranked | (F.col("place") <= limit))
    alone = F.when(~ranked, F.struct("key", "label"))
    placed = near.withColumn("place", F.row_number().over(Window.partitionBy("metric", alone).orderBy(*order))).where(~ranked | (F.col("place") <= limit))
    value = F.when(F.col("metric") == "time", F.bround("mean", 1)).when(F.col("metric") == "hit_rate", F.bround(F.col("mean") * 50, 1))
    return placed.select("metric", "key", "label", "n", value.alias("value"), F.when(ranked, F.col("place")).alias("place"))


def from_log(spark: SparkSession, path: str, now: Column, days: int | None = None, limit: int = 10) -> DataFrame:
    """The report over log files of a path; lines are in order of files and places. A missing path has no lines."""
    return report(logs.lines(spark, path).withColumn("line", F.monotonically_increasing_id()), now, days, limit)
