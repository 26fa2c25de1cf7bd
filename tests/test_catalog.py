"""Every query of the catalogue runs; those with SQL agree with DuckDB."""

from __future__ import annotations

import pytest

import __spark_entry__
from helixframe import catalog
from jobs import queries
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, small, name):
    same(catalog.QUERIES[name](spark, small), catalog.SQL[name], small)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["i", "j", "value"] and df.count() == 441
    for own in (catalog, queries):
        assert set(own.QUERIES) <= set(__spark_entry__.queries()) and set(own.SQL) <= set(__spark_entry__.oracle_sql())
