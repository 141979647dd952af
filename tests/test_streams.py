"""Streams of several batches against the rules over finished tables."""

import datetime
import random
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandwork.sources.sinks import shared_folder
from strandwork.streaming import events as stream, ttl

LIVES = {"a": 30.0, "b": 300.0}


def written(spark, seed, n=400, files=5):
    """(folder, table) of events in files by time, so that each is a batch and none is late."""
    rng = random.Random(seed)
    times = sorted(rng.sample(range(20_000), n))
    rows = [(k, rng.randrange(12) if rng.random() < 0.6 else 99, rng.choice("aab" + "c"), t) for k, t in enumerate(times)]
    folder = f"{shared_folder(spark)}/batches-{uuid.uuid4().hex}"
    table = spark.createDataFrame(rows, "id long, user long, status string, s long").select("id", "user", "status", F.timestamp_seconds("s").alias("ts"))
    for k in range(files):
        table.where((F.col("id") >= k * n // files) & (F.col("id") < (k + 1) * n // files)).coalesce(1).write.mode("append").parquet(folder)
    return folder, table


def read(spark, folder, table):
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(folder)


def drained(spark, frame, mode="append"):
    return stream.drained(frame, f"t-{uuid.uuid4().hex}", mode, shared_folder(spark))


@pytest.mark.parametrize("seed", [1, 2])
def test_expiring_keys_of_many_batches_equal_the_batch_rule(spark, seed):
    folder, table = written(spark, seed)
    got = drained(spark, ttl.expirations(read(spark, folder, table), "user", "status", LIVES))
    now = table.agg(F.max("ts")).first()[0]
    want = ttl.expired(table, "user", "status", LIVES, F.lit(now))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and not want.isEmpty()
    assert {r["status"] for r in got.collect()} == {"a", "b"}
    orphans = ttl.swept(table.select(F.col("user").alias("u"), F.col("user")).distinct(), got, "user")
    assert {r["u"] for r in orphans.collect()} == {r["user"] for r in want.collect()}


def test_waits_and_takeovers_of_many_batches(spark):
    folder, table = written(spark, 3)
    ask, done = table.where("status = 'b'"), table.where("status = 'a'")
    rows = read(spark, folder, table)
    sides = lambda x: (x.where("status = 'b'").select("id", "user", F.col("ts").alias("asked")), x.where("status = 'a'").select("user", F.col("ts").alias("ready")))
    got = stream.settled(drained(spark, stream.waits(*sides(rows), "user", "id", "asked", "ready", "60 seconds")), "id", "user", "asked", "ready")
    first, last = {}, min(ask.agg(F.max("ts")).first()[0], done.agg(F.max("ts")).first()[0])
    a, b = (x.collect() for x in sides(table))
    for r in a:
        hits = [x["ready"] for x in b if x["user"] == r["user"] and 0 <= (x["ready"] - r["asked"]).total_seconds() <= 60]
        if hits or (last - r["asked"]).total_seconds() > 60:
            first[r["id"]] = ("waited", min(hits)) if hits else ("takeover", None)
    assert {r["id"]: (r["outcome"], r["ready"]) for r in got.collect()} == first and len({o for o, _ in first.values()}) == 2


def test_complete_streams_leave_their_last_table_alone(spark):
    folder, table = written(spark, 4, files=3)
    got = drained(spark, read(spark, folder, table).groupBy("status").count(), "complete")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in table.groupBy("status").count().collect()}


def test_a_keys_expirations_are_one_frame_and_few_calls():
    calls = []

    class Held:
        def get(self):
            return calls.append("get") or None

        def update(self, value):
            calls.append("update")

        def clear(self):
            calls.append("clear")

    class Handle:
        def getValueState(self, name, schema):
            return Held()

        def __getattr__(self, name):
            return lambda *of: calls.append(name) or []

    expiry = ttl.Expiry({"a": 1000}, "user", "status", "ts")
    expiry.init(Handle())
    times = [datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=5 * k) for k in range(10)]
    frames = list(expiry.handleInputRows(("u",), iter([pd.DataFrame({"ts": times, "status": ["a"] * 10})]), None))
    assert [len(f) for f in frames] == [9] and list(frames[0]["expired_at"]) == [t + datetime.timedelta(seconds=1) for t in times[:-1]]
    assert calls == ["get", "update", "registerTimer"]
