"""Row predicates over the log."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylog.schema import DATE_COLUMN, as_utc, moment_literal
from querylog.validation import FILTERS, check_choice, check_range


def is_type(response_type: str) -> Column:
    return F.col("response_type") == response_type


def contains_text(column: str, text: str) -> Column:
    """Literal, case-insensitive substring match; null never matches."""
    return F.contains(F.lower(F.col(column)), F.lower(F.lit(text)))


def since(log: DataFrame, start: datetime) -> Column:
    """``request_ts >= start``; rows without a timestamp fail."""
    bound = F.col("request_ts") >= moment_literal(log, start)
    if DATE_COLUMN in log.columns:
        # Stored tables are partitioned by the UTC date: prune whole directories.
        bound = (F.col(DATE_COLUMN) >= F.lit(as_utc(start).date())) & bound
    return bound


def before(log: DataFrame, end: datetime) -> Column:
    """``request_ts < end``."""
    bound = F.col("request_ts") < moment_literal(log, end)
    if DATE_COLUMN in log.columns:
        bound = (F.col(DATE_COLUMN) <= F.lit(as_utc(end).date())) & bound
    return bound


def in_range(log: DataFrame, range: str, as_of: datetime | None) -> Column:
    """The last ``range`` up to ``as_of``. There is no upper bound: rows stamped
    later than ``as_of`` count as current."""
    return since(log, as_utc(as_of) - check_range(range).span)


def blocked_only(filter: str) -> list[Column]:
    check_choice("filter", filter, FILTERS)
    return [is_type("BLOCKED")] if filter == "blocked" else []


def log_predicates(
    search: str | None = None,
    response_type: str | None = None,
    client: str | None = None,
    question_type: str | None = None,
) -> list[Column]:
    """One predicate per given option; absent and empty options give none."""
    found = []
    if search:
        found.append(contains_text("question_name", search))
    if response_type:
        found.append(is_type(response_type))
    if client:
        found.append(contains_text("client_name", client))
    if question_type:
        found.append(F.col("question_type") == question_type)
    return found


def where_all(log: DataFrame, predicates: list[Column]) -> DataFrame:
    return log.where(reduce(and_, predicates)) if predicates else log
