"""Interval covers and quantile sketches against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from strandwork.operators import aggregates as agg, joins


@pytest.mark.parametrize("seed", [1, 2])
def test_spans_of_any_length_cover_what_they_cover(spark, seed):
    rng = random.Random(seed)
    bands = [(k, low := rng.uniform(-500, 500) if k % 5 else float(rng.randrange(-64, 64)), low + (10 ** rng.uniform(-3, 3) if k % 3 else 2.0 ** rng.randrange(-9, 9))) for k in range(150)]
    bands += [(900, 1.0, 1.0), (901, 5.0, 2.0), (902, None, 3.0), (903, -1e18, 1e18)]
    values = [rng.uniform(-600, 600) for _ in range(200)] + [b[1] for b in bands[:60]] + [b[2] for b in bands[:60]] + [None, -0.0, 1e17]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    out = joins.in_bands(rows, spark.createDataFrame(bands, "b int, lo double, hi double"), "v", "lo", "hi")
    want = {(i, b) for i, v in enumerate(values) for b, lo, hi in bands if v is not None and lo is not None and lo <= v < hi}
    got = [(r["i"], r["b"]) for r in out.collect()]
    assert set(got) - want == set() and want - set(got) == set() and len(got) == len(want) and out.columns == ["i", "v", "b", "lo", "hi"]


def test_a_long_span_is_copied_twice_at_most(spark):
    bands = spark.createDataFrame([(1, -1e6, 1e6), (2, 0.0, 1e-6)], "b int, lo double, hi double")
    plan = joins.in_bands(spark.range(100).select(F.col("id").cast("double").alias("v")), bands, "v", "lo", "hi")
    assert plan.count() == 101
    assert joins.in_bands(spark.range(10).select(F.col("id").cast("double").alias("v")), bands.where("b > 5"), "v", "lo", "hi").count() == 0


def test_sketches_of_a_skewed_key_are_near_and_merge(spark):
    rng = random.Random(3)
    rows = [("hot" if k % 20 else "k", rng.paretovariate(1.2)) for k in range(40_000)] + [("hot", None), ("hot", float("nan")), ("none", None)]
    frame = spark.createDataFrame(rows, "k string, x double").repartition(16)
    ranks = [0.01, 0.5, 0.99]
    made = agg.sketched_quantiles(frame, ["k"], "x", ranks)
    got = {r["k"]: (r["n"], r["quantiles"]) for r in made.collect()}
    assert set(got) == {"hot", "k"} and got["hot"][0] == 38_000
    for r in agg.ranks_of(frame, ["k"], "x", made).collect():
        assert all(x["below"] - 0.01 <= want <= x["upto"] + 0.01 for want, x in zip(ranks, r["ranks"]))
    exact = frame.where("k = 'hot' and x is not null and not isnan(x)").agg(F.percentile("x", F.lit(0.5))).first()[0]
    assert abs(got["hot"][1][1] / exact - 1) < 0.05


def test_rows_are_dealt_by_their_number_and_meet_bands_of_equal_columns(spark, monkeypatch):
    from strandwork.operators import joins

    monkeypatch.setattr(joins, "BAND_ROWS", 10)
    rows = spark.range(100).coalesce(1).selectExpr("id", "cast(id as double) AS x", "id % 3 AS third")
    bands = spark.range(9).selectExpr("id AS band", "id * 10.0 AS lo", "id * 10.0 + 15 AS hi", "id % 3 AS third")
    made = joins.in_bands(rows, bands, "x", "lo", "hi", on=["third"])
    assert sorted((r["id"], r["band"]) for r in made.collect()) == sorted((x, b) for x in range(100) for b in range(9) if b * 10 <= x < b * 10 + 15 and x % 3 == b % 3)
    assert "RoundRobinPartitioning(10)" in made._jdf.queryExecution().executedPlan().toString()
