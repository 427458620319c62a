"""Writers."""

from querylog.sinks.table import write_table
from querylog.sinks.tsv import tsv_lines, write_tsv

__all__ = ["tsv_lines", "write_table", "write_tsv"]
