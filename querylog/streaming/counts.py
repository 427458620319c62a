"""Windowed counts over a streamed log.

The windowed frames drop rows later than the watermark, where a batch run would count
them. :func:`counts_to_table` does not: it keeps what each batch adds, and late rows are
corrections that are added like any other.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from querylog.functions.predicates import is_type, log_predicates, where_all
from querylog.operators.ranking import rank_order
from querylog.schema import UNKNOWN, is_wall_clock
from querylog.validation import LIST_KINDS, check_choice, check_range

_NAMES = {"domains": "question_name", "clients": "client_name"}


def _timed(log: DataFrame, watermark: str) -> DataFrame:
    # Watermarks need instants.
    ts = F.col("request_ts")
    instant = ts.cast("timestamp") if is_wall_clock(log) else ts
    return log.withColumn("request_ts", instant).withWatermark("request_ts", watermark)


def _bucket(range: str):
    seconds = int(check_range(range).interval.total_seconds())
    return F.window("request_ts", f"{seconds} seconds")


def windowed_counts(
    log: DataFrame,
    range: str,
    domain: str | None = None,
    client: str | None = None,
    watermark: str = "10 minutes",
) -> DataFrame:
    """``bucket_start, total, blocked, cached`` per clock-aligned bucket of the
    width that ``range`` is drawn with. Buckets without rows do not appear."""
    kept = where_all(_timed(log, watermark), log_predicates(search=domain, client=client))
    return (
        kept.groupBy(_bucket(range).alias("w"))
        .agg(
            F.count("*").alias("total"),
            F.count_if(is_type("BLOCKED")).alias("blocked"),
            F.count_if(is_type("CACHED")).alias("cached"),
        )
        .select(F.col("w.start").alias("bucket_start"), "total", "blocked", "cached")
    )


def windowed_names(
    log: DataFrame, kind: str, range: str, watermark: str = "10 minutes"
) -> DataFrame:
    """``bucket_start, name, count, blocked`` per bucket and domain or client.

    State holds one row per name and open bucket; for many names run it with the
    RocksDB state store. Feed the output to :func:`top_per_bucket`.
    """
    check_choice("kind", kind, LIST_KINDS)
    name = F.coalesce(F.col(_NAMES[kind]), F.lit(UNKNOWN))
    return (
        _timed(log, watermark)
        .groupBy(_bucket(range).alias("w"), name.alias("name"))
        .agg(F.count("*").alias("count"), F.count_if(is_type("BLOCKED")).alias("blocked"))
        .select(F.col("w.start").alias("bucket_start"), "name", "count", "blocked")
    )


def top_per_bucket(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` first-ranked names of each bucket, with their ``position``.

    Spark cuts every task's rows to ``k`` per bucket before they are shuffled.
    """
    ranked = Window.partitionBy("bucket_start").orderBy(*rank_order())
    return counts.withColumn("position", F.row_number().over(ranked)).where(F.col("position") <= k)


def top_names_to_table(
    counts: DataFrame, k: int, path: str, checkpoint: str, output_mode: str = "append", trigger: dict | None = None
) -> StreamingQuery:
    """Keep the ``k`` first names of each bucket of :func:`windowed_names` in a table.

    A batch replaces the buckets it brings, so that a repeated one changes nothing.
    It has to bring them whole: with ``append`` a bucket comes once, when the watermark
    has passed it, with ``complete`` all come each time. In ``update`` mode only names
    that changed would come, and the others would be lost: it is refused. Read the table
    with :func:`read_top_names`.
    """
    if output_mode not in ("append", "complete"):
        raise ValueError(f"top names need whole buckets: append or complete, not {output_mode!r}")

    def replace(rows: DataFrame, batch_id: int) -> None:
        bucket = F.date_format(F.col("bucket_start"), "yyyyMMdd'T'HHmm")
        (
            top_per_bucket(rows, k).withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "position")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        )

    return _started(counts, replace, checkpoint, output_mode, trigger)


def read_top_names(spark: SparkSession, path: str) -> DataFrame:
    """``bucket_start, name, count, blocked, position`` of all buckets stored so far."""
    schema = "bucket_start timestamp, name string, count long, blocked long, position int, bucket string"
    return spark.read.schema(schema).parquet(path).drop("bucket")


_PARTS = "bucket_start timestamp, total long, blocked long, cached long, late long, newest timestamp, batch long"


def counts_to_table(
    log: DataFrame, range: str, path: str, checkpoint: str, domain: str | None = None, client: str | None = None,
    lateness: timedelta = timedelta(minutes=10), trigger: dict | None = None,
) -> StreamingQuery:
    """Keep what each batch adds to the buckets of ``range``, late rows included.

    A batch writes one row per bucket that it touches, under its own number, and writes
    it over when it is repeated. No state is kept, no row is dropped: the sums that
    :func:`merged_counts` makes equal a batch run over the same rows. ``late`` counts
    rows that were more than ``lateness`` older than the newest of earlier batches,
    which a watermark of that delay may drop.
    """
    seconds = int(check_range(range).interval.total_seconds())

    def add(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        kept = where_all(rows, log_predicates(search=domain, client=client))
        ts = F.col("request_ts")
        kept = kept.withColumn("request_ts", ts.cast("timestamp") if is_wall_clock(rows) else ts)
        seen = _parts(spark, path).where(F.col("batch") < batch_id).agg(F.max("newest")).first()[0] if batch_id else None
        mark = F.lit(None).cast("timestamp") if seen is None else F.lit(seen) - F.lit(lateness)
        parts = kept.where("request_ts IS NOT NULL").groupBy(F.window("request_ts", f"{seconds} seconds").alias("w")).agg(
            F.count("*").alias("total"), F.count_if(is_type("BLOCKED")).alias("blocked"), F.count_if(is_type("CACHED")).alias("cached"),
            F.count_if(F.col("request_ts") < mark).alias("late"), F.max("request_ts").alias("newest"),
        )
        parts = parts.select(F.col("w.start").alias("bucket_start"), "total", "blocked", "cached", "late", "newest")
        parts.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _started(log, add, checkpoint, "append", trigger)


def _parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_PARTS).parquet(path)


def merged_counts(spark: SparkSession, path: str) -> DataFrame:
    """``bucket_start, total, blocked, cached, late`` of what batches have added so far."""
    return _parts(spark, path).groupBy("bucket_start").agg(*(F.sum(c).alias(c) for c in ("total", "blocked", "cached", "late")))


def _started(frame: DataFrame, body, checkpoint: str, output_mode: str, trigger: dict | None) -> StreamingQuery:
    return (
        frame.writeStream.foreachBatch(body)
        .outputMode(output_mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
