"""Structured Streaming: following logs, storing them, and counts per time window."""

from querylog.streaming.counts import (
    counts_to_table,
    merged_counts,
    read_top_names,
    top_names_to_table,
    top_per_bucket,
    windowed_counts,
    windowed_names,
)
from querylog.streaming.growing import stream_growing
from querylog.streaming.ingest import stream_jsonl, stream_tsv
from querylog.streaming.table import append_batch, compact_table, stream_to_table

__all__ = [
    "append_batch",
    "compact_table",
    "counts_to_table",
    "merged_counts",
    "read_top_names",
    "stream_growing",
    "stream_jsonl",
    "stream_to_table",
    "stream_tsv",
    "top_names_to_table",
    "top_per_bucket",
    "windowed_counts",
    "windowed_names",
]
