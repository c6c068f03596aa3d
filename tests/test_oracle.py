"""Every query against its SQL. Set TIDELOG_SF_DIR for another scale."""

import os

import pytest

import __spark_entry__ as driver
from tests.oracle import compare, connect

SF_DIR = os.environ.get("TIDELOG_SF_DIR", "/root/testdata/sf0.001")
SQL = driver.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query_equals_sql(spark, db, name):
    verdict = compare(driver.queries()[name](spark, SF_DIR), db, SQL.get(name))
    assert verdict.startswith("ok") or verdict == "EMPTY", verdict


def test_entry_gives_rows(spark):
    assert driver.entry(spark).limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(SQL) <= set(driver.queries())
