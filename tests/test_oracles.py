"""Every registered query against DuckDB on the same tables."""

from __future__ import annotations

import pytest
from compare import assert_same, duckdb_views

import __spark_entry__ as entry_point
from querylog.plans.registered import QUERIES as REGISTERED

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {n: q for n, q in entry_point.queries().items() if n in REGISTERED}
ORACLES = {n: sql for n, sql in entry_point.oracle_sql().items() if n in REGISTERED}


@pytest.fixture(scope="module")
def con():
    return duckdb_views(SF_DIR)


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_matches_duckdb(spark, con, name):
    assert_same(QUERIES[name](spark, SF_DIR), con, ORACLES[name])


def test_entry(spark):
    frame = entry_point.entry(spark)
    assert frame.columns == ["domain", "count", "blocked", "percentage"]
    assert frame.count() == 10
