"""Every query that has SQL, against DuckDB on the smallest tables; the others give rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from cairn.queries import ORACLE_SQL, QUERIES, TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def same(x):
    return None if x is None or (isinstance(x, float) and math.isnan(x)) else round(float(x), 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    ours = sorted((tuple(same(r[n]) for n in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(same(r[names.index(n)]) for n in order) for r in result.fetchall()), key=repr)
    assert ours == theirs


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())
    assert Path(entry.__file__).name == "__spark_entry__.py"
