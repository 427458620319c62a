"""Filtered, paged browsing of log rows, newest first."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylog.functions.predicates import before, in_range, log_predicates, since, where_all
from querylog.operators.paging import Page, page_of
from querylog.operators.timeseries import slot_of
from querylog.schema import EPOCH, LOG_COLUMNS, epoch_micros
from querylog.validation import (
    LOG_PAGE_DEFAULT,
    check_page,
    check_question_type,
    check_response_type,
)

_HOUR = 3_600_000_000  # microseconds
# Slot of rows without a timestamp: after every dated one.
_UNDATED = -(1 << 62)


def log_order() -> list[Column]:
    """Newest first, undated rows last; names and ids settle equal timestamps.

    The other columns settle the rest, so that pages of a log without ids never
    overlap: rows that still tie are copies of each other.
    """
    first = [
        F.desc_nulls_last("request_ts"),
        F.asc_nulls_first("question_name"),
        F.asc_nulls_first("id"),
    ]
    named = {"request_ts", "question_name", "id"}
    return first + [F.asc_nulls_first(c) for c in LOG_COLUMNS if c not in named]


def filtered_logs(
    log: DataFrame,
    search: str | None = None,
    response_type: str | None = None,
    client: str | None = None,
    question_type: str | None = None,
    range: str | None = None,
    as_of: datetime | None = None,
) -> DataFrame:
    check_response_type(response_type)
    check_question_type(question_type)
    predicates = log_predicates(search, response_type, client, question_type)
    if range is not None:
        predicates.append(in_range(log, range, as_of))
    return where_all(log, predicates)


def count_logs(log: DataFrame, **filters) -> DataFrame:
    """One row, ``total_count``: how many rows the filters keep."""
    return filtered_logs(log, **filters).agg(F.count("*").alias("total_count"))


def query_logs(
    log: DataFrame,
    limit: int = LOG_PAGE_DEFAULT,
    offset: int = 0,
    **filters,
) -> Page:
    """A page of log rows, and the number of all.

    A first job counts rows per hour, reading the timestamp and the filtered
    columns only; a row per hour of the log comes back. It yields the total and the
    hours the page lies in; the page itself then reads only those, in full width.
    Where they still hold many rows before the page, :func:`page_of` locates it among
    them by all ordered columns. Those jobs run in this call, the page when its items
    are read: rows that come or go in between can shift it.
    """
    check_page(limit, offset)
    kept = filtered_logs(log, **filters)
    slot = F.coalesce(slot_of(epoch_micros(kept), 0, _HOUR), F.lit(_UNDATED))
    hours = kept.groupBy(slot.alias("slot")).agg(F.count("*").alias("n")).collect()
    total, hits, skip = 0, [], offset
    for at, n in sorted(((r["slot"], r["n"]) for r in hours), reverse=True):
        if total < offset + limit and total + n > offset:
            skip = skip if hits else offset - total
            hits.append(at)
        total += n
    rest = _between(kept, hits[0], hits[-1], _HOUR) if hits else kept.where(F.lit(False))
    rest = rest.select(*LOG_COLUMNS)
    items = page_of(rest, _keys(rest), log_order(), limit, skip if hits else 0)
    totals = log.sparkSession.range(1).select(F.lit(total).cast("long").alias("total_count"))
    return Page(items, totals)


def _keys(rows: DataFrame) -> list[Column]:
    """What :func:`log_order` sorts by, as ascending keys."""
    time = F.coalesce(-epoch_micros(rows), F.lit(-_UNDATED))
    first = [time, F.col("question_name"), F.col("id")]
    return first + [F.col(c) for c in LOG_COLUMNS if c not in ("request_ts", "question_name", "id")]


def _between(rest: DataFrame, first: int, last: int, width: int) -> DataFrame:
    """Rows of the located slots, bounded on the bare timestamp column."""
    undated = F.col("request_ts").isNull()
    if first == _UNDATED:
        return rest.where(undated)
    try:
        upper = before(rest, _moment(first + 1, width))
    except OverflowError:
        upper = F.lit(True)  # the slot ends with the calendar: nothing is newer
    if last == _UNDATED:
        return rest.where(undated | upper)
    return rest.where(since(rest, _moment(last, width)) & upper)


def _moment(slot: int, width: int) -> datetime:
    return EPOCH + timedelta(microseconds=slot * width)
