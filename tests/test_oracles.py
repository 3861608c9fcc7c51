"""Every query with an SQL twin gives the twin's rows on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA
from tools.check import TABLES, canon

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    cur = con.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(columns, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
