"""Registered queries against their SQL on the small tables."""

import datetime as dt
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value.replace(tzinfo=None) if isinstance(value, dt.datetime) else value


def sorted_rows(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=repr)


def test_every_query_has_sql():
    assert set(entry.ORACLE) == set(entry.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.ORACLE))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted_rows([[row[names.index(c)] for c in columns] for row in cursor.fetchall()])
    assert sorted_rows(df.select(*[f"`{c}`" for c in columns]).collect()) == want
