"""Checks of caller-supplied parameters."""

from __future__ import annotations

from querylog.schema import QUESTION_TYPES, RESPONSE_TYPES, TIME_RANGES, TimeRange

# Page sizes and their bounds.
LOG_PAGE_DEFAULT = 50
LIST_PAGE_DEFAULT = 10
PAGE_MAX = 100
SEARCH_DEFAULT = 10
SEARCH_MAX = 50

FILTERS = ("all", "blocked")
LIST_KINDS = ("domains", "clients")


def check_range(name: str) -> TimeRange:
    return TIME_RANGES[check_choice("range", name, TIME_RANGES)]


def check_choice(what: str, value, allowed):
    if value not in allowed:
        raise ValueError(f"{what} must be one of {', '.join(allowed)}, not {value!r}")
    return value


def check_int(what: str, value, low: int, high: int | None = None) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise ValueError(f"{what} must be an integer, not {value!r}")
    if value < low or (high is not None and value > high):
        bound = f"at least {low}" if high is None else f"between {low} and {high}"
        raise ValueError(f"{what} must be {bound}, not {value}")
    return value


def check_page(limit: int, offset: int) -> None:
    check_int("limit", limit, 1, PAGE_MAX)
    check_int("offset", offset, 0)


def check_search(limit: int) -> None:
    check_int("limit", limit, 1, SEARCH_MAX)


def check_response_type(value: str | None) -> None:
    if value:
        check_choice("response_type", value, RESPONSE_TYPES)


def check_question_type(value: str | None) -> None:
    if value:
        check_choice("question_type", value, QUESTION_TYPES)
