"""Scans against plain loops: one key with most rows, ties, nulls, empty tables, recurrences of many levels."""

import random

import pytest
from pyspark.sql import functions as F

from strandwork.operators import scans


def loop(rows, start, factor):
    out, last = {}, {}
    for key, at, x in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        last[key] = factor(at) * last.get(key, start) + x
        out[key, at] = last[key]
    return out


def made(n, hot=0.7, seed=1):
    rng = random.Random(seed)
    at = rng.sample(range(10 * n), n)
    return [(None if rng.random() < 0.05 else "hot" if rng.random() < hot else f"k{rng.randrange(20)}", at[k], rng.randrange(100) / 8) for k in range(n)]


def test_running_sums_and_places_of_a_hot_key(spark):
    rows = made(4000)
    out = scans.prefix_sums(spark.createDataFrame(rows, "k string, at long, x double").repartition(5), ["k"], ["at"], {"total": F.col("x"), "place": F.lit(1)}, parts=16).collect()
    seen = {}
    want = {}
    for key, at, x in sorted(rows, key=lambda r: r[1]):
        total, place = seen.get(key, (0.0, 0))
        seen[key] = want[key, at] = (total + x, place + 1)
    assert {(r["k"], r["at"]): (r["total"], r["place"]) for r in out} == want


def test_no_task_holds_the_hot_key(spark):
    rows = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("at"))
    out = scans.places(rows, ["k"], ["at"], parts=8)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_span" in plan
    shares = scans.cut(rows.repartitionByRange(8, "k", "at")).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in shares) < 6000 and out.where("place <> at + 1").isEmpty()


def test_ties_and_no_key_number_all_rows(spark):
    rows = spark.range(3000).select(F.lit(1).alias("x"), (F.col("id") % 3).alias("_tie"))
    places = sorted(r["place"] for r in scans.places(rows, [], ["x"], parts=4).collect())
    assert places == list(range(1, 3001))
    assert scans.places(rows.where("x > 1"), [], ["x"]).count() == 0


@pytest.mark.parametrize("fan", [3, 128])
def test_recurrence_equals_a_loop(spark, monkeypatch, fan):
    monkeypatch.setattr(scans, "FAN", fan)
    rows = made(1500, seed=fan)
    frame = spark.createDataFrame(rows, "k string, at long, x double").repartition(4)
    out = scans.affine_scan(frame, ["k"], ["at"], F.when(F.col("at") % 7 == 0, 0.0).otherwise(0.9), F.col("x"), start=2.0, parts=8).collect()
    want = loop(rows, 2.0, lambda at: 0.0 if at % 7 == 0 else 0.9)
    assert len(out) == len(want) and all(abs(r["y"] - want[r["k"], r["at"]]) < 1e-9 * max(1.0, abs(want[r["k"], r["at"]])) for r in out)


def test_recurrence_of_an_empty_table_and_of_single_rows(spark):
    frame = spark.createDataFrame([("a", 1, 5.0), ("b", 1, None)], "k string, at long, x double")
    half = lambda rows: scans.affine_scan(rows, ["k"], ["at"], F.lit(0.5), F.col("x"))
    assert sorted((r["k"], r["y"]) for r in half(frame).collect()) == [("a", 5.0), ("b", None)]
    assert half(frame.where("at > 1")).count() == 0


def test_tasks_grow_with_the_rows(spark):
    from strandwork.operators import scans

    assert scans.shares(spark.range(1000), 10) == 100 and scans.shares(spark.range(0), 10) == scans.shares(spark.range(39), 10) == 4


def test_stem_publication_deals_lines_by_their_number(spark, monkeypatch):
    from conftest import SF001
    from strandwork.plans import catalogue, catalogue_files

    monkeypatch.setattr(catalogue_files, "LINES_A_TASK", 500)
    plan = catalogue.queries()["stem_publication"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    n = -(-spark.read.parquet(f"{SF001}/lineitem.parquet").count() // 500)
    assert "hashpartitioning(l_orderkey#" in plan and f", {n})" in plan
