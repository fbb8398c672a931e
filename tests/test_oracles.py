"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from tessera import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        found.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return found


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SMALL)
    want = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == sorted(map(repr, want.fetchall()))


def test_contract(spark):
    assert {*catalog.QUERIES} <= {*contract.queries()}
    assert {*contract.oracle_sql()} <= {*contract.queries()}
    assert contract.entry(spark).count() > 0
