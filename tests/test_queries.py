"""Every registered query equals its SQL twin on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare
from scanloom.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) <= set(SQL) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    outcome = compare(spark, con, name, QUERIES[name], SQL[name], SF_DIR)
    assert outcome.startswith("ok") and "TYPES" not in outcome, outcome


def test_entry(spark):
    assert entry.entry(spark).count() == 40
