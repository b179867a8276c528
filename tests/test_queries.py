"""Every query against its check SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from lectern.plans.catalog import QUERIES
from lectern.plans.checks import CHECKS
from tools.compare import rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    result = contract.queries()[name](spark, SF)
    wanted = duck.sql(contract.oracle_sql()[name])
    columns = list(wanted.columns)
    assert sorted(result.columns) == sorted(columns)
    got = rows_of(result.columns, [tuple(r) for r in result.collect()])
    assert got == rows_of(columns, wanted.fetchall())


def test_entry(spark):
    picks = contract.entry(spark)
    assert 0 < picks.count() <= 5 * 150
