"""Writing logs as a columnar table partitioned by date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylog.schema import DATE_COLUMN, LOG_COLUMNS, is_wall_clock, utc_wall_clock


def with_date(log: DataFrame) -> DataFrame:
    """Add the UTC date by which stored tables are partitioned."""
    ts = F.col("request_ts")
    wall = ts if is_wall_clock(log) else utc_wall_clock(ts)
    return log.select(*LOG_COLUMNS, F.to_date(wall).alias(DATE_COLUMN))


def write_table(
    log: DataFrame,
    path: str,
    mode: str = "errorifexists",
    format: str = "parquet",
    rebalance: bool = True,
) -> None:
    """Store the log once; range queries on it skip directories and row groups.

    Rebalancing splits large days over several tasks and lets small ones share.
    It shuffles the log: leave it out where each input file covers few days, as
    daily log files do. Rows are sorted by time within a file, so that each row
    group spans little of it.
    """
    rows = with_date(log)
    if rebalance:
        rows = rows.hint("rebalance", DATE_COLUMN)
    (
        rows.sortWithinPartitions(DATE_COLUMN, "request_ts")
        .write.mode(mode)
        .format(format)
        .partitionBy(DATE_COLUMN)
        .save(path)
    )
