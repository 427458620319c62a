"""Gap-filled counts over time."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querylog.functions.predicates import before, is_type, log_predicates, since, where_all
from querylog.schema import EPOCH, as_utc, epoch_micros, micros, utc_wall_clock
from querylog.validation import check_choice, check_range

MODES = ("aligned", "anchored")

_MICROSECOND = timedelta(microseconds=1)


def slot_of(moment: Column, origin: int, width: int) -> Column:
    """Index of the bucket holding ``moment`` (both in microseconds).

    Integer arithmetic, exact at any timestamp; rounds down before the origin too.
    """
    shifted = moment - F.lit(origin)
    return F.call_function("div", shifted - F.pmod(shifted, F.lit(width)), F.lit(width))


def queries_over_time(
    log: DataFrame,
    range: str,
    domain: str | None = None,
    client: str | None = None,
    mode: str = "aligned",
    as_of: datetime | None = None,
) -> DataFrame:
    """``bucket_start, total, blocked, cached`` for every bucket of the range.

    ``aligned`` buckets start on the UTC clock; the first and the current one are
    partial, and rows stamped after ``as_of`` count in the current one.
    ``anchored`` buckets start at ``as_of - range``, and later rows are dropped.
    """
    span = check_range(range)
    check_choice("mode", mode, MODES)
    now = as_utc(as_of)
    start = now - span.span
    if mode == "aligned":
        origin, width, buckets = aligned_buckets(range, now)
    else:
        origin, width, buckets = micros(start), span.interval // _MICROSECOND, span.buckets
    end = EPOCH + (origin + buckets * width) * _MICROSECOND

    # Both bounds are on the bare column, and they bound the groups as well: at
    # most 31 rows leave the aggregation, whatever is in the log.
    bounds = [since(log, start), before(log, end)]
    counts = (
        where_all(log, bounds + log_predicates(search=domain, client=client))
        .groupBy(slot_of(epoch_micros(log), origin, width).alias("slot"))
        .agg(
            F.count("*").alias("total"),
            F.count_if(is_type("BLOCKED")).alias("blocked"),
            F.count_if(is_type("CACHED")).alias("cached"),
        )
    )
    return on_spine(log.sparkSession, counts, origin, width, buckets)


def aligned_buckets(range: str, now: datetime) -> tuple[int, int, int]:
    """First moment and width in microseconds, and number, of clock-aligned buckets."""
    span = check_range(range)
    width = span.interval // _MICROSECOND
    origin = micros(now - span.span) // width * width
    return origin, width, (micros(now) - origin) // width + 1


def on_spine(spark: SparkSession, counts: DataFrame, origin: int, width: int, buckets: int) -> DataFrame:
    """Counts per slot as a series with every bucket; ``counts`` has one row per slot."""
    spine = spark.range(0, buckets, 1, 1).withColumnRenamed("id", "slot")
    return (
        spine.join(F.broadcast(counts), "slot", "left")
        .select(
            F.timestamp_micros(F.lit(origin) + F.col("slot") * F.lit(width)).alias("bucket_start"),
            *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "blocked", "cached")),
        )
        .orderBy("bucket_start")
    )


def with_bucket_labels(series: DataFrame, range: str) -> DataFrame:
    """Add the bucket's UTC label: minutes, or the date alone for daily buckets."""
    pattern = check_range(range).label_format
    label = F.date_format(utc_wall_clock(F.col("bucket_start")), pattern)
    return series.withColumn("label", label)
