"""Readers. Each returns a frame in the canonical log schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from querylog.sources.jdbc import open_database, read_jdbc
from querylog.sources.jsonl import read_jsonl
from querylog.sources.payloads import parse_payloads, read_payloads
from querylog.sources.table import read_table
from querylog.sources.tsv import parse_tsv_lines, read_tsv, tsv_rejects

# Names of the source kinds. "table" is the stored columnar form.
SOURCE_KINDS = (
    "csv",
    "csv-client",
    "mysql",
    "postgresql",
    "timescale",
    "sqlite",
    "console",
    "table",
)


def read_query_log(spark: SparkSession, kind: str, target: str | None, **options) -> DataFrame:
    """Open a query log by source kind and target.

    The target is a directory (``csv``, ``csv-client``), a connection URI
    (``mysql``, ``postgresql``, ``timescale``), a database file (``sqlite``), a
    path of exported JSON lines (``console``), or a path or table (``table``).
    """
    if kind not in SOURCE_KINDS:
        raise ValueError(f"kind must be one of {', '.join(SOURCE_KINDS)}, not {kind!r}")
    if not target:
        raise ValueError(f"a target is required for source kind {kind!r}")
    if kind == "csv":
        return read_tsv(spark, target, **options)
    if kind == "csv-client":
        return read_tsv(spark, target, per_client=True, **options)
    if kind == "console":
        return read_jsonl(spark, target, **options)
    if kind == "table":
        return read_table(spark, target, **options)
    return read_jdbc(spark, kind, target, **options)


__all__ = [
    "SOURCE_KINDS",
    "open_database",
    "parse_payloads",
    "parse_tsv_lines",
    "read_jdbc",
    "read_jsonl",
    "read_payloads",
    "read_query_log",
    "read_table",
    "read_tsv",
    "tsv_rejects",
]
