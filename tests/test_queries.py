"""Every query with SQL gives the rows of its SQL on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans.oracle import SQL
from tidemark.plans.queries import QUERIES

FOLDER = Path(os.environ.get("TIDEMARK_TESTDATA", "/root/testdata"), "sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")
TABLES = ("nation", "part", "lineitem", "events", "documents", "orders", "customer")


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    for name in TABLES:
        found.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return found


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(r[i] for i in order) for r in records], key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(FOLDER))
    sql = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows(df.columns, df.collect()) == rows(sql.columns, sql.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(entry.queries())
