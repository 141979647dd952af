"""What SQL cannot express, against plain loops."""

import math

import numpy as np
from pyspark.sql import functions as F

from conftest import SF001
from strandwork.operators import kernels
from strandwork.plans import catalogue
from strandwork.streaming import state


def test_monotone_stream_equals_the_highest(spark):
    out = catalogue.queries()["stream_monotone"](spark, SF001)
    want = spark.read.parquet(f"{SF001}/events.parquet").groupBy("user_id").agg(F.max("value").alias("highest"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_progress_keeps_only_rises():
    assert state.progress_step(2.0, [1, 3, 3, 2, 5]) == (5, [3, 5])


def test_leases():
    steps = [("acquire", "a", 0), ("acquire", "b", 10), ("renew", "a", 80), ("acquire", "b", 169), ("acquire", "b", 171), ("ready", "a", 172), ("fail", "b", 180), ("acquire", "a", 190), ("acquire", "a", 300)]
    s, seen = {}, []
    for op, token, t in steps:
        s, outcome = state.lease_step(s, {"op": op, "token": token, "t": t})
        seen.append(outcome)
    assert seen == ["granted", "busy", "renewed", "busy", "takeover", "not_owner", "failed", "waiting", "granted"]


def test_replay_equals_a_loop(spark):
    rows = [("k%d" % (i % 3), ("acquire", "renew", "ready", "fail", "release")[i * 7 % 5], str(i % 2), float(i * 13 % 400)) for i in range(200)]
    got = state.replay_leases(spark.createDataFrame(rows, "key string, op string, token string, t double")).collect()
    want = []
    for key in {r[0] for r in rows}:
        s = {}
        for _, op, token, t in sorted((r for r in rows if r[0] == key), key=lambda r: (r[3], r[1], r[2])):
            s, outcome = state.lease_step(s, {"op": op, "token": token, "t": t})
            want.append((key, t, op, token, outcome))
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)


def test_compress_lowers_peaks_only():
    quiet = 0.01 * np.sin(np.arange(8000) / 10)
    loud = np.sin(np.arange(8000) / 10)
    gain = lambda x: np.abs(kernels.compress(x, 8000)[4000:]).max() / np.abs(x).max()
    assert gain(loud) <= gain(quiet) + 1e-9
    assert np.abs(kernels.compress(loud, 8000)[4000:]).max() <= np.abs(loud).max() + 1e-9


def test_soft_clip_stays_below_its_ceiling(spark):
    x = spark.createDataFrame([(v,) for v in (-3.0, -0.1, 0.0, 0.1, 0.5, 3.0)], "x double").select("x", kernels.soft_clip(F.col("x"), 0.2).alias("y"))
    for r in x.collect():
        assert abs(r["y"]) <= 0.2 and math.copysign(1, r["y"]) == math.copysign(1, r["x"]) or r["x"] == 0
