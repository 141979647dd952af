"""Queries whose rows meet a tie, an edge of a rounding rule or a null, against their SQL."""

import datetime

import duckdb
import pytest

from strandwork.plans import catalogue
from test_queries import rows


def equal_to_sql(spark, folder, name, **tables):
    """Write (schema, rows) as tables in a folder, run a query over them, and compare it with its SQL."""
    con = duckdb.connect()
    for table, (schema, made) in tables.items():
        spark.createDataFrame(made, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    df = catalogue.queries()[name](spark, str(folder))
    want = con.execute(catalogue.oracle_sql()[name])
    found = rows(df.columns, map(tuple, df.collect()))
    assert found == rows([d[0] for d in want.description], want.fetchall())
    return found


ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
DAY = datetime.datetime(2024, 1, 5)


def test_beats_are_rounded_half_even(spark, tmp_path):
    made = [(k, 1, "F", 150.0 + 300 * k, DAY, "1") for k in range(200, 240)]
    equal_to_sql(spark, tmp_path, "duration_gate", orders=(ORDERS, made))


def test_equal_spans_are_repaired_by_id(spark, tmp_path):
    made = [(k, plan, "F", 1.0, DAY + datetime.timedelta(days=d), "1") for plan in range(20) for d, ids in ((0, (405 + plan, 205 + plan)), (300, (430, 630, 30))) for k in ids]
    equal_to_sql(spark, tmp_path, "interval_repair", orders=(ORDERS, made))


def test_stretch_is_named_half_even(spark, tmp_path):
    made = [(k, 1, "F", 255_000.0 + 5000 * k, DAY, "1") for k in range(12)]
    found = equal_to_sql(spark, tmp_path, "red_flags", orders=(ORDERS, made))
    assert any("high_stretch_26%" in r for r in found)


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_silence_of_no_length_and_in_powers(spark, tmp_path):
    made = [(k, DAY, 1, kind, v, "{}") for k, (kind, v) in enumerate((kind, v) for kind in ("view", "click") for v in (0.0, 0.0001, 0.00015, 0.5, 10.0, 10.5, 2.5e7, -3.0, None))]
    equal_to_sql(spark, tmp_path, "silence_probe", events=(EVENTS, made))
