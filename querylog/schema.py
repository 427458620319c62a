"""The one fixed shape of a query log, its vocabularies and time ranges."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Canonical columns. Every reader returns exactly these, in this order.
LOG_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("request_ts", T.TimestampType()),
        T.StructField("client_ip", T.StringType()),
        T.StructField("client_name", T.StringType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("reason", T.StringType()),
        T.StructField("response_type", T.StringType()),
        T.StructField("question_type", T.StringType()),
        T.StructField("question_name", T.StringType()),
        T.StructField("effective_tldp", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("response_code", T.StringType()),
        T.StructField("hostname", T.StringType()),
    ]
)

LOG_COLUMNS = LOG_SCHEMA.fieldNames()

#: Partition column of stored log tables: the UTC date of ``request_ts``.
DATE_COLUMN = "request_date"

# The vocabularies a filter may name. Logs may hold other values
# and rows are never dropped for that.
RESPONSE_TYPES = (
    "RESOLVED",
    "BLOCKED",
    "CACHED",
    "CONDITIONAL",
    "CUSTOMDNS",
    "HOSTSFILE",
    "SPECIAL",
    "FILTERED",
    "NOTFQDN",
)
QUESTION_TYPES = ("A", "AAAA", "CNAME", "MX", "TXT")

#: Label of the group of rows whose name is null.
UNKNOWN = "unknown"


@dataclass(frozen=True)
class TimeRange:
    """A look-back span cut into equal buckets."""

    name: str
    span: timedelta
    interval: timedelta
    label_format: str

    @property
    def buckets(self) -> int:
        return self.span // self.interval


# The four offered ranges, their bucket widths and bucket labels.
TIME_RANGES = {
    "1h": TimeRange("1h", timedelta(hours=1), timedelta(minutes=5), "yyyy-MM-dd HH:mm"),
    "24h": TimeRange("24h", timedelta(hours=24), timedelta(hours=1), "yyyy-MM-dd HH:mm"),
    "7d": TimeRange("7d", timedelta(days=7), timedelta(hours=6), "yyyy-MM-dd HH:mm"),
    "30d": TimeRange("30d", timedelta(days=30), timedelta(days=1), "yyyy-MM-dd"),
}

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
UTC_NAMES = {"UTC", "Etc/UTC", "GMT", "Z", "+00:00"}


def as_utc(moment: datetime | None) -> datetime:
    """``moment`` in UTC; a naive value is taken as UTC, None as the current time."""
    if moment is None:
        return datetime.now(timezone.utc)
    if moment.tzinfo is None:
        return moment.replace(tzinfo=timezone.utc)
    return moment.astimezone(timezone.utc)


def micros(moment: datetime) -> int:
    """Microseconds since the epoch, exact."""
    return (as_utc(moment) - EPOCH) // timedelta(microseconds=1)


def utc_text(moment: datetime) -> str:
    """``moment`` as ``YYYY-MM-DD hh:mm:ss.ffffff`` in UTC."""
    return as_utc(moment).replace(tzinfo=None).isoformat(" ", "microseconds")


def is_wall_clock(log: DataFrame) -> bool:
    """Whether ``request_ts`` carries UTC wall-clock values instead of instants."""
    wall = isinstance(log.schema["request_ts"].dataType, T.TimestampNTZType)
    if wall and log.sparkSession.conf.get("spark.sql.session.timeZone") not in UTC_NAMES:
        raise ValueError(
            "request_ts is TIMESTAMP_NTZ, read as UTC: set spark.sql.session.timeZone to UTC"
        )
    return wall


def moment_literal(log: DataFrame, moment: datetime) -> Column:
    """``moment`` as a literal of the type of ``request_ts``.

    The column itself stays bare in comparisons, so the bound reaches the scan
    as a pushed filter.
    """
    text = utc_text(moment)
    if is_wall_clock(log):
        return F.lit(text).cast("timestamp_ntz")
    return F.lit(text + "+00:00").cast("timestamp")


def epoch_micros(log: DataFrame) -> Column:
    """``request_ts`` as microseconds since the epoch."""
    ts = F.col("request_ts")
    return F.unix_micros(ts.cast("timestamp") if is_wall_clock(log) else ts)


def utc_wall_clock(instant: Column) -> Column:
    """The UTC wall clock of an instant, whatever the session time zone."""
    return F.convert_timezone(None, F.lit("UTC"), instant.cast("timestamp_ntz"))


def to_log_schema(
    frame: DataFrame, keep: Sequence[str] = (), empty_as_null: bool = True, **columns: Column
) -> DataFrame:
    """Project ``frame`` to :data:`LOG_SCHEMA`, followed by the columns to ``keep``.

    ``columns`` gives expressions for columns not found under their canonical
    name; what is neither given nor present is null. Wall-clock timestamps stay
    what they are. A column already of its type is passed on bare, so filters on
    it still reach the source; turning empty strings into nulls prevents that.
    """
    present = {name.lower(): name for name in frame.columns}
    out = []
    for field in LOG_SCHEMA:
        found = present.get(field.name)
        if field.name in columns:
            value = columns[field.name]
        elif found is not None:
            value = F.col(found)
            kind = frame.schema[found].dataType
            if kind == field.dataType or isinstance(kind, T.TimestampNTZType):
                if empty_as_null and kind == T.StringType():
                    value = F.nullif(value, F.lit(""))
                out.append(value.alias(field.name))
                continue
        else:
            value = F.lit(None)
        if field.dataType == T.StringType():
            value = value.cast("string")
            value = F.nullif(value, F.lit("")) if empty_as_null else value
        else:
            value = value.try_cast(field.dataType)
        out.append(value.alias(field.name))
    return frame.select(*out, *keep)
