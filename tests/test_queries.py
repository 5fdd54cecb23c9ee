"""Every registered query against its DuckDB SQL."""

import os

import pytest

import __spark_entry__ as entry_point
from faultline.plans import oracles
from faultline.plans.queries import QUERIES
from tests.compare import differences, oracle_connection

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
SQL = oracles.build()


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(entry_point.queries()) and set(SQL) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert differences(entry_point.queries()[name](spark, SF), con, SQL[name]) == []


def test_entry(spark):
    assert entry_point.entry(spark).count() == 84
