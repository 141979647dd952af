"""Event-time aggregates. Event times must be of type timestamp; `as_timestamp` casts zone-less ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandwork.sources.sinks import remove


def as_timestamp(events: DataFrame, time: str = "ts") -> DataFrame:
    return events.withColumn(time, F.col(time).cast("timestamp"))


def window_counts(events: DataFrame, time: str, key: str, width: str, slide: str | None = None, late: str | None = None, value: str | None = None) -> DataFrame:
    """(window_start, key, n[, total]) in tumbling or sliding windows; late rows are dropped after the watermark."""
    rows = events.withWatermark(time, late) if late else events
    window = F.window(time, width, slide) if slide else F.window(time, width)
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.sum(value).alias("total")] if value else [])
    return rows.groupBy(window.alias("w"), key).agg(*aggs).select(F.col("w.start").alias("window_start"), key, *(["n", "total"] if value else ["n"]))


def deduplicated(events: DataFrame, time: str, keys: list[str], within: str) -> DataFrame:
    """The first event of each key within a time: one flight of equal requests."""
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def session_counts(events: DataFrame, time: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    """(session_start, session_end, key, n); events exactly a gap apart share a session, the end is the last event's plus the gap."""
    rows = events.withWatermark(time, late) if late else events
    out = rows.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")


def joined_within(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, within: str, how: str = "inner") -> DataFrame:
    """Stream-stream join of events of one key of which the right one follows within a time; both sides need watermarks.

    With `how` left, a left event that nothing follows comes with nulls, once the watermark tells that nothing will.
    """
    r = right.withColumnRenamed(key, "_rk")
    return left.join(r, F.expr(f"{key} = _rk AND {right_time} >= {left_time} AND {right_time} <= {left_time} + INTERVAL {within}"), how).drop("_rk")


def waits(requests: DataFrame, results: DataFrame, key: str, request: str, asked: str, ready: str, patience: str, late: str = "0 seconds") -> DataFrame:
    """(request, key, asked, ready) of requests that wait for a result of their key, and of those that take over (ready is null).

    A request that has waited its patience out without a result takes over the work; it is told apart when the watermarks of
    both streams have passed that time. A request that several results follow comes once for each; `settled` keeps the first.
    """
    left = requests.select(request, key, asked).withWatermark(asked, late)
    right = results.select(key, ready).withWatermark(ready, late)
    return joined_within(left, right, key, asked, ready, patience, "leftOuter")


def settled(found: DataFrame, request: str, key: str, asked: str, ready: str) -> DataFrame:
    """(request, key, outcome, ready): one row a request, by its first result: `waited` or `takeover`."""
    first = found.groupBy(request, key, asked).agg(F.min(ready).alias(ready))
    return first.select(request, key, F.when(F.col(ready).isNull(), "takeover").otherwise("waited").alias("outcome"), ready)


def drained(stream: DataFrame, name: str, mode: str, folder: str) -> DataFrame:
    """Run a stream over what is available into Parquet files below a shared folder, and return the table.

    Appended rows go to a file sink as they are. A complete result replaces the table of the batch before, which is
    named by its number; the files of the last batch are the result. Nothing goes through the driver. The stream's own
    checkpoint is deleted at its end, and tables of earlier batches too.
    """
    spark, path = stream.sparkSession, f"{folder.rstrip('/')}/{name}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{path}/rows").start()
        query.awaitTermination()
        remove(spark, f"{path}/checkpoint")
        return spark.read.schema(stream.schema).parquet(f"{path}/rows")
    done = []  # foreachBatch runs on the driver

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows-{number}")
        if done:
            remove(spark, f"{path}/rows-{done[-1]}")
        done.append(number)

    writer.foreachBatch(put).start().awaitTermination()
    remove(spark, f"{path}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{path}/rows-{done[-1]}") if done else spark.createDataFrame([], stream.schema)
