"""DNS query-log analytics on Spark."""

from querylog.api import QueryLog
from querylog.operators.paging import Page
from querylog.schema import LOG_SCHEMA, QUESTION_TYPES, RESPONSE_TYPES, TIME_RANGES
from querylog.sinks import write_table, write_tsv
from querylog.sources import read_payloads, read_query_log

__all__ = [
    "LOG_SCHEMA",
    "Page",
    "QUESTION_TYPES",
    "QueryLog",
    "RESPONSE_TYPES",
    "TIME_RANGES",
    "read_payloads",
    "read_query_log",
    "write_table",
    "write_tsv",
]
