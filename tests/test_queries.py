"""Registered queries against their oracle SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF_DIR
from tools.check import TABLES, normal


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 15


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.execute(entry.oracle_sql()[name])
    assert got == normal([d[0] for d in rel.description], rel.fetchall())
