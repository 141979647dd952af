"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import json
import math
from pathlib import Path

import duckdb
import pytest

from conftest import SF001
from strandwork.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v if v is None or isinstance(v, (bool, int)) else str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(json.dumps([plain(r[k]) for k in order]) for r in found)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF001).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF001)
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, map(tuple, df.collect())) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF001)
    assert len(set(df.columns)) == len(df.columns) and df.count() >= 0


def test_entry_works_without_the_llm_folders(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
