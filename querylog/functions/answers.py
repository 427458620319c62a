"""Parsing of DNS answers and of the reason a resolver gives for its response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The answer and reason formats.
RECORD_SEPARATOR = r",\s+(?=[A-Z0-9]+\s+\()"
RECORD = r"^[A-Z0-9]+\s+\((.*)\)\z"
BLOCK_REASON = r"(?i)^BLOCKED(?: [^(]+)? \((.*)\)\z"
GROUP_SEPARATOR = ": "
# Whitespace as ECMAScript's trim() knows it.
SPACES = (
    "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def trim_space(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def parse_answers(answer: Column) -> Column:
    """``A (192.0.2.1), MX (10 m.)`` to ``[192.0.2.1, 10 m.]``.

    Records not written as ``TYPE (value)`` are kept as they are; an empty
    answer has no records.
    """
    records = F.transform(
        F.split(answer, RECORD_SEPARATOR),
        lambda record: F.regexp_replace(record, RECORD, "$1"),
    )
    return F.when(answer == "", F.array().cast("array<string>")).otherwise(records)


def blocking_group(reason: Column) -> Column:
    """The list that blocked a name: ``BLOCKED (ads: *.example)`` to ``ads``."""
    details = F.regexp_extract(trim_space(reason), BLOCK_REASON, 1)
    return F.when(
        F.instr(details, GROUP_SEPARATOR) > 1,
        F.substring_index(details, GROUP_SEPARATOR, 1),
    )


def result_detail(response_type: Column, reason: Column) -> Column:
    """Blocking group of blocked responses; otherwise the reason, unless it only
    repeats the response type."""
    return F.when(F.upper(response_type) == "BLOCKED", blocking_group(reason)).when(
        ~F.upper(reason).eqNullSafe(F.upper(response_type)), reason
    )


def query_results(
    results: DataFrame,
    response_type: str = "response_type",
    return_code: str = "response_code",
    response: str = "answer",
    reason: str = "reason",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Assemble parsed query results from raw response columns."""
    return results.select(
        *keep,
        F.col(response_type).alias("response_type"),
        F.col(return_code).alias("return_code"),
        parse_answers(F.col(response)).alias("answers"),
        result_detail(F.col(response_type), F.col(reason)).alias("detail"),
    )
