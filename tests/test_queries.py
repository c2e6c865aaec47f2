"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from compare import compare

from __spark_entry__ import entry, oracle_sql
from itemweld import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = oracle_sql()


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_matches_sql(spark, name):
    problem, rows, _, _ = compare(spark, FOLDER, name, registry.QUERIES[name], SQL.get(name))
    assert problem is None, problem


def test_every_query_has_sql():
    assert set(registry.QUERIES) <= set(SQL)


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0
