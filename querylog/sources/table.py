"""Query logs stored as columnar tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from querylog.schema import DATE_COLUMN
from querylog.sources.jdbc import normalise_rows


def read_table(
    spark: SparkSession, target: str, format: str = "parquet", empty_as_null: bool = False
) -> DataFrame:
    """Log rows of a path, or of a catalog table if the name has no slash.

    Tables written by :func:`querylog.sinks.write_table` keep their date column,
    by which range filters skip whole directories.
    """
    rows = spark.read.format(format).load(target) if "/" in target else spark.table(target)
    keep = [DATE_COLUMN] if DATE_COLUMN in rows.columns else []
    return normalise_rows(rows, keep, empty_as_null)
