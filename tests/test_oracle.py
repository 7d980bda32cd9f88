"""Every registered query against its DuckDB statement, on the smallest tables."""

import pytest

import __spark_entry__ as registry
from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", registry.graph_queries())
def test_query(spark, con, name):
    ok, note = compare(spark, con, FOLDER, name)
    assert ok, note


def test_every_query_has_a_statement():
    assert set(registry.graph_queries()) == set(registry.graph_sql()) <= set(registry.queries())


def test_entry(spark):
    df = registry.entry(spark)
    assert df.columns == ["node_id", "arrival_time"] and df.count() == 100
