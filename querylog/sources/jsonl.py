"""Query logs exported as JSON lines from a log store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querylog.schema import to_log_schema
from querylog.sources.tsv import parse_timestamp

# Field names of a record, and the mark of query records.
QUERY_PREFIX = "queryLog"
_RENAMED = {
    "client_ip": "client_ip",
    "client_name": "client_names",
    "reason": "response_reason",
    "question_name": "question_name",
    "answer": "answer",
    "response_code": "response_code",
    "response_type": "response_type",
    "question_type": "question_type",
}
RECORD_SCHEMA = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("_time", "prefix", "duration_ms", *_RENAMED.values())
    ]
)


def map_records(records: DataFrame, time_zone: str = "UTC") -> DataFrame:
    """Query records, already split into fields, as log rows."""
    number = F.nullif(F.col("duration_ms"), F.lit(""))
    whole = F.when(F.rlike(number, F.lit(r"^\s*[+-]?\d+\s*$")), number.try_cast("long")).otherwise(
        number.try_cast("double").try_cast("long")
    )
    columns = {name: F.col(source) for name, source in _RENAMED.items()}
    columns["request_ts"] = parse_timestamp(F.col("_time"), time_zone)
    columns["duration_ms"] = whole
    missing = {name: F.lit(None) for name in ("id", "effective_tldp", "hostname")}
    return to_log_schema(records.where(F.col("prefix") == QUERY_PREFIX), **columns, **missing)


def parse_jsonl_lines(
    lines: DataFrame, line: str = "value", malformed: str = "fail", time_zone: str = "UTC"
) -> DataFrame:
    """Log rows of raw JSON lines; blank lines are skipped.

    ``malformed="fail"`` raises on a line that is no JSON object, ``"drop"``
    leaves it out.
    """
    mode = {"fail": "FAILFAST", "drop": "PERMISSIVE"}[malformed]
    filled = lines.where(F.trim(line) != "")
    record = F.from_json(line, RECORD_SCHEMA, {"mode": mode})
    # Catalyst does not push filters through a generator: lines are parsed once.
    return map_records(filled.select(F.inline(F.array(record))), time_zone)


def read_jsonl(
    spark: SparkSession, path: str, malformed: str = "fail", time_zone: str = "UTC"
) -> DataFrame:
    """Log rows of exported JSON-lines files (see :func:`parse_jsonl_lines`)."""
    mode = {"fail": "FAILFAST", "drop": "DROPMALFORMED"}[malformed]
    records = spark.read.schema(RECORD_SCHEMA).option("mode", mode).json(path)
    return map_records(records, time_zone)
