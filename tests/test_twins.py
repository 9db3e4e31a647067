"""Every query with a twin gives the same rows in Spark and in DuckDB."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.twins import compare, connect

SF_DIR = "/root/testdata/sf0.001"
TWINS = oracle_sql()
# Fits with the full settings take minutes; test_models covers these operators with small models.
FITTED = {name for name, build in queries().items() if build.__module__ == "ledgerloom.catalog.model_queries"}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(set(TWINS) - FITTED))
def test_twin(spark, con, name):
    assert compare(spark, con, queries()[name], TWINS[name], SF_DIR) is None


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0
    assert len(df.columns) == len(set(df.columns))


def test_names_match():
    assert set(TWINS) <= set(queries())
