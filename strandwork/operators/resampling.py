"""Signals at another rate, chunk by chunk: windowed-sinc weights by phase, and edges exchanged between neighbours.

A signal is rows (keys, chunk, samples): chunk k holds the samples from k * size on, and all but a key's last hold `size`. An
output sample needs some input on both sides of it, so each chunk gets the end of the chunk before and the begin of the
one after, as rows to that chunk's number: a shuffle by (keys, chunk), in which a long signal is many small groups.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Zero crossings of the sinc on each side of its middle.
HALF = 16


def chunked(rows: DataFrame, keys: Sequence[str], place: str, value: str, size: int) -> DataFrame:
    """(keys, chunk, samples) of rows with their place from 0, without gaps, in their key."""
    chunk = F.floor(F.col(place) / size)
    made = rows.groupBy(*keys, chunk.alias("chunk")).agg(F.sort_array(F.collect_list(F.struct(place, F.col(value).cast("double").alias("_x")))).alias("_s"))
    return made.select(*keys, "chunk", F.transform("_s", lambda s: s["_x"]).alias("samples"))


def reach(rate: int, wanted: int, half: int = HALF) -> int:
    """Input samples that an output sample needs on each side."""
    return math.ceil(half * max(1.0, rate / wanted))


def phase_weights(spark: SparkSession, rate: int, wanted: int, half: int = HALF) -> DataFrame:
    """(phase, weights): of each place of an output sample between two inputs, the weights of the inputs around it; their sum is 1.

    An output sample at input i + phase / phases weighs inputs i - reach + 1 to i + reach by a sinc, cut off at the lower of both
    rates' half and faded by a cosine-squared window.
    """
    phases, side, cut = wanted // math.gcd(rate, wanted), reach(rate, wanted, half), min(1.0, wanted / rate)
    d = F.col("phase") / phases + side - 1 - F.col("tap")
    x = d * cut * math.pi
    sinc = F.when(F.abs(d) < 1e-12, 1.0).otherwise(F.sin(x) / x)
    raw = spark.range(phases).select(F.col("id").alias("phase"), F.explode(F.sequence(F.lit(0), F.lit(2 * side - 1))).alias("tap"))
    raw = raw.withColumn("w", sinc * F.pow(F.cos(d * math.pi / (2 * side)), 2))
    held = raw.groupBy("phase").agg(F.sort_array(F.collect_list(F.struct("tap", "w"))).alias("t"), F.sum("w").alias("s"))
    return held.select("phase", F.transform("t", lambda t: t["w"] / F.col("s")).alias("weights"))


def resampled(chunks: DataFrame, keys: Sequence[str], rate: int, wanted: int, size: int, half: int = HALF) -> DataFrame:
    """(keys, chunk, first, samples): the signals at another rate; `first` is the place of a chunk's first output sample.

    A signal of n samples has ceil(n * wanted / rate); outside of it is silence. The result does not depend on `size`, which must be
    `reach` at least. Equal rates give the samples themselves. An empty table gives no rows, an empty chunk none.
    """
    rows = chunks.select(*keys, F.col("chunk").cast("long").alias("chunk"), F.col("samples").cast("array<double>").alias("samples")).where(F.size("samples") > 0)
    start = F.col("chunk") * size
    if rate == wanted:
        return rows.select(*keys, "chunk", start.alias("first"), "samples")
    common = math.gcd(rate, wanted)
    up, down, side = wanted // common, rate // common, reach(rate, wanted, half)
    if size < side:
        raise ValueError(f"chunks of {size} samples are shorter than the {side} that an output sample needs on each side")
    ends = rows.select(*keys, F.explode(F.array(
        F.struct((F.col("chunk") + 1).alias("chunk"), F.slice("samples", -F.least(F.size("samples"), F.lit(side)), side).alias("before"), F.lit(None).cast("array<double>").alias("after")),
        F.struct((F.col("chunk") - 1).alias("chunk"), F.lit(None).cast("array<double>").alias("before"), F.slice("samples", 1, side).alias("after")),
    )).alias("e")).select(*keys, "e.*", F.lit(None).cast("array<double>").alias("samples"))
    own = rows.select(*keys, "chunk", *[F.lit(None).cast("array<double>").alias(c) for c in ("before", "after")], "samples")
    met = own.unionByName(ends).groupBy(*keys, "chunk").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("before", "after", "samples")]).where("samples is not null")

    def silent(side_of: Column) -> Column:
        return F.coalesce(side_of, F.array().cast("array<double>"))

    zeros = lambda x: F.array_repeat(F.lit(0.0), F.lit(side) - F.size(x))
    before, after = silent(F.col("before")), silent(F.col("after"))
    padded = met.withColumn("padded", F.concat(zeros(before), before, "samples", after, zeros(after)))
    first, stop = F.ceil(start * up / down), F.ceil((start + F.size("samples")) * up / down)
    padded = padded.withColumn("first", first.cast("long")).withColumn("stop", stop.cast("long")).where("stop > first")
    table = phase_weights(rows.sparkSession, rate, wanted, half).agg(F.transform(F.sort_array(F.collect_list(F.struct("phase", "weights"))), lambda p: p["weights"]).alias("table"))  # one row of `up` phases

    def output(m: Column) -> Column:
        at = F.floor(m * down / up)
        taps = F.slice("padded", (at - start + 2).cast("int"), 2 * side)
        return F.aggregate(F.zip_with(taps, F.get("table", (m * down % up).cast("int")), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)

    made = padded.join(F.broadcast(table))
    return made.select(*keys, "chunk", "first", F.transform(F.sequence("first", F.col("stop") - 1), output).alias("samples"))
