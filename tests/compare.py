"""Row-for-row comparison of a Spark result with DuckDB's for the same query."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duckdb_views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def _bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def assert_same(frame, con: duckdb.DuckDBPyConnection, sql: str) -> int:
    """Compare as bags of rows with columns by name. Returns the row count."""
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    expected = relation.fetchall()
    assert sorted(frame.columns) == sorted(names)
    rows = frame.collect()
    assert len(rows) == len(expected)
    assert _bag(frame.columns, rows) == _bag(names, expected)
    return len(rows)
