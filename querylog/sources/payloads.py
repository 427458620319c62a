"""Statistics payloads: nested JSON documents, one per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The payload's fields. Others are ignored. Numbers of any form are valid.
_COUNTED = T.ArrayType(
    T.StructType([T.StructField("name", T.StringType()), T.StructField("count", T.DoubleType())])
)
_SIZES = T.MapType(T.StringType(), T.DoubleType())
PAYLOAD_SCHEMA = T.StructType(
    [
        T.StructField(
            "summary",
            T.StructType(
                [
                    T.StructField("queries", T.DoubleType()),
                    T.StructField("blocked", T.DoubleType()),
                    T.StructField("dropped", T.DoubleType()),
                    T.StructField("errors", T.DoubleType()),
                    T.StructField("avgResponseMs", T.DoubleType()),
                    T.StructField("cacheHitRate", T.DoubleType()),
                ]
            ),
        ),
        T.StructField("topDomains", _COUNTED),
        T.StructField("topBlockedDomains", _COUNTED),
        T.StructField("topClients", _COUNTED),
        T.StructField(
            "lists",
            T.StructType([T.StructField("denylist", _SIZES), T.StructField("allowlist", _SIZES)]),
        ),
        T.StructField("cache", T.StructType([T.StructField("entries", T.DoubleType())])),
    ]
)


def _complete(value: Column, kind: T.DataType) -> Column:
    """Whether a value and all that it must contain is present."""
    present = value.isNotNull()
    if isinstance(kind, T.StructType):
        for field in kind:
            present = present & _complete(value[field.name], field.dataType)
    elif isinstance(kind, T.ArrayType):
        present = present & F.forall(value, lambda item: _complete(item, kind.elementType))
    elif isinstance(kind, T.MapType):
        present = present & F.forall(F.map_values(value), lambda item: item.isNotNull())
    return present


def parse_payloads(documents: DataFrame, text: str = "value") -> DataFrame:
    """Replace the JSON in column ``text`` by the struct ``payload``, null where
    the document is malformed: unreadable, of other types, or short of a field."""
    keep = [c for c in documents.columns if c != text]
    # A projection of its own, so that each document is parsed once.
    parsed = documents.select(*keep, F.from_json(text, PAYLOAD_SCHEMA).alias("payload"))
    whole = F.when(_complete(F.col("payload"), PAYLOAD_SCHEMA), F.col("payload"))
    return parsed.select(*keep, whole.alias("payload"))


def read_payloads(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Parsed ``payload`` per line, or per file with ``whole_files``."""
    return parse_payloads(spark.read.text(path, wholetext=whole_files).select("value"))
