"""Registered queries against their SQL in DuckDB, on the smallest given tables."""

import os
import sys

import pytest

import __spark_entry__ as spark_entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))
from compare import compare, duck  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="given tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(spark_entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    ok, note = compare(spark, con, name, spark_entry.queries()[name], spark_entry.oracle_sql()[name], SF_DIR)
    assert ok, note


def test_every_sql_belongs_to_a_query():
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())


def test_entry(spark):
    assert spark_entry.entry(spark).count() == 1
