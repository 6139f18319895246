"""Every registered query that has SQL against DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from ledgerloom.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float) and value == int(value):
        return int(value)
    return str(value) if not isinstance(value, (int, float, type(None))) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF)
    expected = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in expected.description]
    assert sorted(found.columns) == sorted(columns)
    rows = sorted(str([plain(v) for v in r]) for r in found.select(columns).collect())
    assert rows == sorted(str([plain(v) for v in r]) for r in expected.fetchall())
