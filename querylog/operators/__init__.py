"""Questions to a log frame; :class:`querylog.QueryLog` bundles them."""

from querylog.operators.logs import count_logs, query_logs
from querylog.operators.paging import Page
from querylog.operators.ranking import (
    list_shares,
    page_info,
    query_types_breakdown,
    search_clients,
    search_domains,
    suggestions,
    top_clients,
    top_domains,
    top_list,
)
from querylog.operators.rollup import Rollup, hourly_counts, rolled_names, rolled_series, write_rollup
from querylog.operators.snapshot import (
    overview_24h,
    payload_top_lists,
    snapshot_overview,
    snapshot_top_lists,
    stats_24h,
)
from querylog.operators.timeseries import queries_over_time, with_bucket_labels

__all__ = [
    "Page",
    "Rollup",
    "count_logs",
    "hourly_counts",
    "list_shares",
    "overview_24h",
    "page_info",
    "payload_top_lists",
    "queries_over_time",
    "rolled_names",
    "rolled_series",
    "write_rollup",
    "query_logs",
    "query_types_breakdown",
    "search_clients",
    "search_domains",
    "snapshot_overview",
    "snapshot_top_lists",
    "stats_24h",
    "suggestions",
    "top_clients",
    "top_domains",
    "top_list",
    "with_bucket_labels",
]
