"""Every registered query with an SQL twin against DuckDB over the whole small tables."""

import pytest
from compare import compare, duck

import __spark_entry__ as entry_module

SQLS = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("key", sorted(SQLS))
def test_equals_duckdb(spark, sf_dir, con, key):
    assert compare(entry_module.queries()[key](spark, sf_dir), con, SQLS[key]) == []


def test_entry_has_rows(spark):
    df = entry_module.entry(spark)
    assert "Sales_mean" in df.columns and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(SQLS) <= set(entry_module.queries())
