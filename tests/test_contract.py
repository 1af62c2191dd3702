"""Every registered query against its SQL twin in DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, canon

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_same_as_sql(spark, duck, key):
    frame = QUERIES[key](spark, FOLDER)
    got = (frame.columns, [tuple(r) for r in frame.collect()])
    cursor = duck.execute(ORACLES[key])
    want = ([d[0] for d in cursor.description], cursor.fetchall())
    assert sorted(got[0]) == sorted(want[0])
    assert canon(got) == canon(want)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 8
    assert set(ORACLES) <= set(QUERIES)
