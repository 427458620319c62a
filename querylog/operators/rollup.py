"""Hourly counts per name beside a stored log, and answers from them.

A rollup holds, for each hour, how many rows each domain, client and record type has, and
how many of them are blocked and cached. It is kept by date: dates that gained rows are
counted again and replace what was there. A question about a range adds up the whole
hours of finished dates and reads the log itself only for the broken hour at its start
and for what is newer than the rollup. Sums are additive, so the answer is that of a full
scan, however the moment that ranges look back from cuts the hours.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date, datetime, time, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylog.functions.predicates import before, contains_text, is_type, since
from querylog.operators.timeseries import aligned_buckets, on_spine, slot_of
from querylog.schema import DATE_COLUMN, EPOCH, UNKNOWN, as_utc, epoch_micros, micros
from querylog.sinks.table import with_date
from querylog.validation import check_choice, check_range

_HOUR = 3_600_000_000  # microseconds
#: Kinds of names that are counted, and their columns.
KINDS = {"domains": "question_name", "clients": "client_name", "types": "question_type"}
ROLLUP_SCHEMA = f"hour long, kind string, name string, count long, blocked long, cached long, {DATE_COLUMN} date"


@dataclass(frozen=True)
class Rollup:
    """Hourly counts, and the last date that they hold whole."""

    counts: DataFrame
    through: date | None

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Rollup:
        """A rollup as :func:`write_rollup` leaves it; all but its last date is final.

        The last date may still grow, so the log itself answers for it.
        """
        counts = spark.read.schema(ROLLUP_SCHEMA).parquet(path)
        last = counts.agg(F.max(DATE_COLUMN)).first()[0]
        return cls(counts, None if last is None else last - timedelta(days=1))


def hourly_counts(log: DataFrame) -> DataFrame:
    """``hour`` (since the epoch), ``kind``, ``name`` and counts of a log's dated rows.

    One pass: each row gives its domain, client and record type, which are counted
    together and combined before the shuffle. Rows without a name have the name null.
    """
    names = F.inline(F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(column).alias("name")) for kind, column in KINDS.items())))
    hour = slot_of(epoch_micros(log), 0, _HOUR)
    rows = log.where("request_ts IS NOT NULL").select(hour.alias("hour"), "response_type", names)
    return rows.groupBy("hour", "kind", "name").agg(
        F.count("*").alias("count"), F.count_if(is_type("BLOCKED")).alias("blocked"), F.count_if(is_type("CACHED")).alias("cached")
    )


def write_rollup(log: DataFrame, path: str, dates: Iterable[date] | None = None) -> None:
    """Count a stored log by hour; ``dates`` limits it to those that gained rows.

    Dates are replaced one by one, so a call that is repeated changes nothing. Only the
    directories of those dates are read.
    """
    dated = log if DATE_COLUMN in log.columns else with_date(log)
    if dates is not None:
        dated = dated.where(F.col(DATE_COLUMN).isin(list(dates)))
    counts = hourly_counts(dated)
    day = F.date_add(F.lit(date(1970, 1, 1)), F.floor(F.col("hour") / 24).cast("int"))
    (
        counts.withColumn(DATE_COLUMN, day).hint("rebalance", DATE_COLUMN).sortWithinPartitions(DATE_COLUMN, "kind", "name", "hour")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DATE_COLUMN).parquet(path)
    )


def _parts(log: DataFrame, rollup: Rollup, start: datetime) -> DataFrame:
    """Counts by hour, kind and name of all rows from ``start`` on, in pieces to be added up."""
    first = -(-micros(start) // _HOUR)
    whole = EPOCH + timedelta(microseconds=first * _HOUR)
    if rollup.through is None or whole.date() > rollup.through:
        return hourly_counts(log.where(since(log, start)))
    beyond = datetime.combine(rollup.through + timedelta(days=1), time(), timezone.utc)
    stored = rollup.counts.where(
        (F.col(DATE_COLUMN) >= F.lit(whole.date())) & (F.col(DATE_COLUMN) <= F.lit(rollup.through)) & (F.col("hour") >= first)
    )
    newer = hourly_counts(log.where(since(log, beyond)))
    found = stored.drop(DATE_COLUMN).unionByName(newer)
    if start < whole:
        found = found.unionByName(hourly_counts(log.where(since(log, start) & before(log, whole))))
    return found


def rolled_names(
    log: DataFrame, rollup: Rollup, kind: str, range: str, as_of: datetime | None = None, filter: str = "all", containing: str | None = None
) -> DataFrame:
    """``name, count, blocked`` of a range: what grouping the log itself gives.

    With ``filter="blocked"`` both count blocked rows. ``containing`` keeps names that hold
    a text, regardless of case; rows without a name are not found then, else they are
    "unknown".
    """
    check_choice("kind", kind, tuple(KINDS))
    start = as_utc(as_of) - check_range(range).span
    rows = _parts(log, rollup, start).where(F.col("kind") == kind)
    if containing is not None:
        rows = rows.where(contains_text("name", containing) if containing.strip() else F.lit(False))
    sums = rows.groupBy(F.coalesce("name", F.lit(UNKNOWN)).alias("name")).agg(*(F.sum(c).alias(c) for c in ("count", "blocked")))
    if filter == "blocked":
        return sums.where("blocked > 0").select("name", F.col("blocked").alias("count"), "blocked")
    return sums


def rolled_series(log: DataFrame, rollup: Rollup, range: str, as_of: datetime | None = None) -> DataFrame:
    """The clock-aligned series of a range whose buckets are hours or more.

    Every row has one record type, so those counts add up to all rows.
    """
    now, span = as_utc(as_of), check_range(range)
    origin, width, buckets = aligned_buckets(range, now)
    if width % _HOUR:
        raise ValueError(f"the buckets of {range} are shorter than an hour")
    at = F.col("hour") * F.lit(_HOUR)
    rows = _parts(log, rollup, now - span.span).where((F.col("kind") == "types") & (at < origin + buckets * width))
    counts = rows.groupBy(slot_of(at, origin, width).alias("slot")).agg(
        F.sum("count").alias("total"), F.sum("blocked").alias("blocked"), F.sum("cached").alias("cached")
    )
    return on_spine(log.sparkSession, counts, origin, width, buckets)
