"""Writing logs as tab-separated files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylog.schema import is_wall_clock, utc_wall_clock
from querylog.sources.tsv import TSV_FIELDS

#: Client part of the path when all clients of a day share their files.
ALL_CLIENTS = "ALL"
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _wall_clock(log: DataFrame) -> Column:
    ts = F.col("request_ts")
    return ts if is_wall_clock(log) else utc_wall_clock(ts)


def client_key(client_name: Column) -> Column:
    """Client name as a path part; names of one client joined by ``"; "`` are
    joined by ``-`` instead."""
    joined = F.replace(F.coalesce(client_name, F.lit("")), F.lit("; "), F.lit("-"))
    return F.regexp_replace(joined, "[^a-zA-Z0-9_-]", "_")


def tsv_lines(log: DataFrame, per_client: bool = False, fraction: bool = True) -> DataFrame:
    """``log_date, client_key, request_ts, line`` per log row.

    Timestamps are UTC without a zone; without ``fraction`` they are cut to seconds. Line
    breaks and tabs inside a value become spaces, as they would break the line.
    """
    shown = TIMESTAMP_FORMAT + (".SSSSSS" if fraction else "")
    wall = _wall_clock(log)
    fields = {name: F.translate(F.col(name).cast("string"), "\t\r\n", "   ") for name in TSV_FIELDS}
    fields["request_ts"] = F.date_format(wall, shown)
    line = F.concat_ws("\t", *(F.coalesce(fields[name], F.lit("")) for name in TSV_FIELDS))
    key = client_key(F.col("client_name")) if per_client else F.lit(ALL_CLIENTS)
    return log.select(
        F.to_date(wall).alias("log_date"), key.alias("client_key"), "request_ts", line.alias("line")
    )


def write_tsv(
    log: DataFrame,
    path: str,
    per_client: bool = False,
    fraction: bool = True,
    mode: str = "errorifexists",
) -> None:
    """Write ``path/log_date=…/client_key=…/part-*.txt``, each file in time order.

    The readers of tab-separated logs take such a path as it is, by date too.

    Rebalancing evens out the work: small clients share tasks, and a client that
    holds much of a day is split over several tasks and so over several files.
    """
    lines = tsv_lines(log, per_client, fraction).hint("rebalance", "log_date", "client_key")
    (
        lines.sortWithinPartitions("log_date", "client_key", "request_ts")
        .select("log_date", "client_key", "line")
        .write.mode(mode)
        .partitionBy("log_date", "client_key")
        .text(path)
    )
