"""Row functions: predicates, parsers and display values."""

from querylog.functions.answers import (
    blocking_group,
    parse_answers,
    query_results,
    result_detail,
)
from querylog.functions.display import (
    compact_count,
    duration_label,
    percentage,
    reason_note,
    reason_text,
    short_count,
)

__all__ = [
    "blocking_group",
    "compact_count",
    "duration_label",
    "parse_answers",
    "percentage",
    "query_results",
    "reason_note",
    "reason_text",
    "result_detail",
    "short_count",
]
