"""Query logs kept in a database table, read in parallel slices or asked in place."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from urllib.parse import parse_qsl, unquote, urlencode, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylog.schema import as_utc, to_log_schema, utc_text
from querylog.sources.slices import count_query, planned
from querylog.sources.tsv import parse_timestamp

# Table name, drivers and session settings per database.
TABLE = "log_entries"
_DRIVERS = {
    "mysql": "com.mysql.cj.jdbc.Driver",
    "postgresql": "org.postgresql.Driver",
    "sqlite": "org.sqlite.JDBC",
}
_UTC_SESSION = {
    "mysql": {"connectionTimeZone": "UTC", "forceConnectionTimeZoneToSession": "true"},
    "postgresql": {"sessionInitStatement": "SET TIME ZONE 'UTC'"},
    "sqlite": {"open_mode": "1"},  # read-only
}
_SCHEMES = {"mysql": ("mysql",), "postgresql": ("postgresql", "postgres"), "sqlite": ()}
_ALIASES = {"timescale": "postgresql"}


def jdbc_options(kind: str, target: str) -> dict[str, str]:
    """Reader options for a connection URI (or a file path for SQLite)."""
    kind = _ALIASES.get(kind, kind)
    options = {"driver": _DRIVERS[kind], "dbtable": TABLE, **_UTC_SESSION[kind]}
    if kind == "sqlite":
        path = target.removeprefix("sqlite://").removeprefix("file:")
        return {"url": f"jdbc:sqlite:{path}", **options}
    uri = urlsplit(target)
    if uri.scheme not in _SCHEMES[kind] or not uri.hostname:
        raise ValueError(f"not a {kind} connection URI: {uri.scheme}://{uri.hostname or ''}")
    host = f"[{uri.hostname}]" if ":" in uri.hostname else uri.hostname
    port = f":{uri.port}" if uri.port else ""
    query = urlencode(parse_qsl(uri.query))
    options["url"] = f"jdbc:{kind}://{host}{port}{uri.path}" + (f"?{query}" if query else "")
    if uri.username:
        options["user"] = unquote(uri.username)
    if uri.password:
        options["password"] = unquote(uri.password)
    return options


def time_slices(
    start: datetime, end: datetime, slices: int, since: datetime | None = None
) -> list[str]:
    """Disjoint predicates covering the table: ``slices`` equal ones between
    ``start`` and ``end``, one before, one after, and one for missing times.

    With ``since`` they cover the rows from that moment on. Each bounds the bare
    column, so the database answers it from its time index.
    """
    start, end = as_utc(start), as_utc(end)
    if since is not None:
        start, end = max(start, as_utc(since)), max(end, as_utc(since))

    def text(moment: datetime) -> str:
        return f"'{utc_text(moment)}'"

    edges = [start + (end - start) * i / slices for i in range(slices + 1)]
    found = [
        f"request_ts >= {text(low)} AND request_ts < {text(high)}"
        for low, high in zip(edges, edges[1:])
        if low < high
    ]
    found.append(f"request_ts >= {text(max(edges))}")
    if since is None:
        found += [f"request_ts < {text(start)}", "request_ts IS NULL"]
    elif as_utc(since) < start:
        found.append(f"request_ts >= {text(as_utc(since))} AND request_ts < {text(start)}")
    return found


def _since_text(kind: str, since: datetime, sample: str | None) -> str:
    """A moment in the form that the table compares timestamps in."""
    text = utc_text(since)
    # SQLite compares text: the separator has to be the stored one
    return text[:10] + sample[10] + text[11:] if kind == "sqlite" and sample and len(sample) > 10 else text


def depth_slices(
    spark: SparkSession, kind: str, target: str, rows_per_slice: int, since: datetime | None = None, table: str = TABLE, **options: str
) -> list[str]:
    """Disjoint predicates over about equally many rows each, planned from counts that
    the database makes; without ``since`` they cover the whole table.

    A count reads the time index once per level and returns a row per hour (or finer
    key of the few hours that hold too much), whatever the number of log rows.
    """
    kind = _ALIASES.get(kind, kind)
    settings = {**jdbc_options(kind, target), **options}
    settings.pop("dbtable", None)

    def ask(query: str) -> list:
        return spark.read.format("jdbc").options(**settings, query=query).load().collect()

    def count(level: str, low: str | None, high: str | None) -> list[tuple[str, int]]:
        return [(r[0], int(r[1])) for r in ask(count_query(kind, table, level, low, high))]

    low = None
    if since is not None:
        sample = None
        if kind == "sqlite":
            sample = ask(f"SELECT MAX(request_ts) AS sample FROM {table}")[0][0]
        low = _since_text(kind, since, sample)
    found = [s.predicate() for s in planned(count, rows_per_slice, low)]
    return found if since is not None else [*found, "request_ts IS NULL"]


def read_jdbc(
    spark: SparkSession,
    kind: str,
    target: str,
    start: datetime | None = None,
    end: datetime | None = None,
    slices: int | None = None,
    since: datetime | None = None,
    table: str = TABLE,
    empty_as_null: bool = False,
    rows_per_slice: int = 1_000_000,
    fetch_size: int = 10_000,
    **options: str,
) -> DataFrame:
    """Log rows of a database table; the driver JAR is the caller's to provide.

    The table is read in parallel: the database counts rows per hour first, and each
    task reads a slice of about ``rows_per_slice`` rows, ``fetch_size`` at a time. With
    ``start``, ``end`` and ``slices`` nothing is counted and slices are equally long
    instead, which suits a log of even load; ``slices=1`` alone reads it in one task.
    ``since`` leaves out what is older. Empty strings are kept unless ``empty_as_null``,
    so that filters run in the database. Extra options go to the reader.
    """
    settings = {**jdbc_options(kind, target), "dbtable": table, "fetchsize": str(fetch_size), **options}
    if start is not None and end is not None:
        predicates = time_slices(start, end, slices or 32, since)
    elif slices == 1:
        predicates = [f"request_ts >= '{utc_text(since)}'" if since is not None else "1 = 1"]
    elif slices is not None:
        raise ValueError("slices need a start and an end; without them the database counts rows")
    else:
        predicates = depth_slices(spark, kind, target, rows_per_slice, since, settings["dbtable"], **options)
    url, name = settings.pop("url"), settings.pop("dbtable")
    rows = spark.read.jdbc(url, name, predicates=predicates, properties=settings)
    return normalise_rows(rows, empty_as_null=empty_as_null)


def catalog_options(kind: str, target: str, **options: str) -> dict[str, str]:
    """Settings of a database catalog that answers counts, groups and top rows itself."""
    settings = {**jdbc_options(kind, target), **options}
    settings.pop("dbtable", None)
    pushed = ("pushDownPredicate", "pushDownAggregate", "pushDownLimit", "pushDownOffset", "pushDownTableSample")
    return {**settings, **dict.fromkeys(pushed, "true")}


def open_database(
    spark: SparkSession, kind: str, target: str, name: str = "querylog_database", table: str = TABLE, **options: str
) -> DataFrame:
    """A database table as a frame whose filters, counts and groups the database runs.

    For questions that come down to few rows: totals, ranked names, record types. What
    the database cannot be asked (time buckets) is still computed here, on rows that
    arrive through one connection: read those with :func:`read_jdbc`. Columns stay as
    they are stored, for only bare columns reach the database. ``table`` may be
    qualified by a schema; ``name`` is that of the session's catalog, one per target.
    """
    prefix = f"spark.sql.catalog.{name}"
    spark.conf.set(prefix, "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog")
    for key, value in catalog_options(kind, target, **options).items():
        spark.conf.set(f"{prefix}.{key}", value)
    return spark.table(f"{name}.{table}")


def normalise_rows(
    rows: DataFrame, keep: Sequence[str] = (), empty_as_null: bool = False
) -> DataFrame:
    """Stored rows in the log schema; text timestamps are parsed as UTC."""
    columns = {}
    if dict(rows.dtypes).get("request_ts") == "string":
        columns["request_ts"] = parse_timestamp(F.col("request_ts"))
    return to_log_schema(rows, keep, empty_as_null, **columns)
