"""Following log directories as streams, with the parsers of the batch readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from querylog.sources.jsonl import RECORD_SCHEMA, map_records
from querylog.sources.tsv import LOG_FILES, WRITTEN_FILES, has_both_layouts, is_written, parse_tsv_lines


def stream_tsv(
    spark: SparkSession,
    directory: str,
    glob: str | None = None,
    strict_trim: bool = False,
    time_zone: str = "UTC",
    max_files_per_trigger: int = 1000,
) -> DataFrame:
    """Log rows of tab-separated files as they appear in a directory.

    Files are taken up once: they must appear complete; for those that grow in place
    there is :func:`querylog.streaming.stream_growing`. A directory that ``write_tsv``
    wrote is recognised as the batch reader does; one that holds log files as well
    raises, for a stream follows one layout. ``glob`` names other files.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger)
    if glob is None and is_written(spark, directory):
        if has_both_layouts(spark, directory, LOG_FILES):
            raise ValueError(f"{directory} holds log files beside written dates: name one of them by glob")
        reader = reader.option("recursiveFileLookup", True)
        glob = WRITTEN_FILES
    lines = reader.option("pathGlobFilter", glob or LOG_FILES).text(directory).select("value")
    return parse_tsv_lines(lines, strict_trim=strict_trim, time_zone=time_zone)


def stream_jsonl(
    spark: SparkSession,
    directory: str,
    malformed: str = "fail",
    time_zone: str = "UTC",
    max_files_per_trigger: int = 1000,
) -> DataFrame:
    """Log rows of exported JSON-lines files as they appear in a directory."""
    mode = {"fail": "FAILFAST", "drop": "DROPMALFORMED"}[malformed]
    records = (
        spark.readStream.schema(RECORD_SCHEMA)
        .option("mode", mode)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .json(directory)
    )
    return map_records(records, time_zone)
