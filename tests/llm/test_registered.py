"""Registered queries on training text against DuckDB."""

from __future__ import annotations

import pytest
from compare import assert_same, duckdb_views

import __spark_entry__ as entry_point
from querylog.llm.registered import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert {*QUERIES, "pipeline"} <= entry_point.queries().keys()
    assert ORACLES.keys() <= entry_point.oracle_sql().keys()
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}


@pytest.mark.parametrize("name", ORACLES)
def test_matches_duckdb(spark, name):
    assert_same(QUERIES[name](spark, SF_DIR), duckdb_views(SF_DIR), ORACLES[name])
