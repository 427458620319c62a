"""Totals of the last 24 hours, and snapshots from statistics payloads."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querylog.functions.display import percentage
from querylog.functions.predicates import in_range, is_type
from querylog.operators.ranking import rank_order
from querylog.schema import UNKNOWN

# Fixed value: entries per list that is made from the log.
LIST_LENGTH = 5


def stats_24h(log: DataFrame, as_of: datetime | None = None, at_source: bool = False) -> DataFrame:
    """One row: ``total_queries, blocked`` of the last 24 hours.

    ``at_source`` counts in a form that databases take.
    """
    blocked = F.count_if(is_type("BLOCKED"))
    if at_source:
        blocked = F.coalesce(F.sum(F.when(is_type("BLOCKED"), 1).otherwise(0)), F.lit(0))
    return log.where(in_range(log, "24h", as_of)).agg(F.count("*").alias("total_queries"), blocked.alias("blocked"))


def overview_24h(log: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """One row of the statistics overview, as far as the log can tell it.

    The hit rate is cached responses among cached and forwarded (RESOLVED) ones.
    """
    cached, forwarded = F.count_if(is_type("CACHED")), F.count_if(is_type("RESOLVED"))
    counts = log.where(in_range(log, "24h", as_of)).agg(
        F.count("*").alias("total_queries"),
        F.count_if(is_type("BLOCKED")).alias("blocked"),
        cached.alias("cached"),
        forwarded.alias("forwarded"),
        F.avg("duration_ms").alias("avg_response_ms"),
    )
    lookups = F.col("cached") + F.col("forwarded")
    return counts.select(
        "*",
        percentage(F.col("blocked"), F.col("total_queries")).alias("blocked_percentage"),
        percentage(F.col("cached"), lookups).alias("cache_hit_rate"),
    )


def snapshot_top_lists(log: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """``list, name, count``: top domains, blocked domains and clients of 24 h.

    One pass: each row gives its domain and its client, which are counted together,
    and each list takes its first entries from those counts.
    """
    kept = log.where(in_range(log, "24h", as_of))
    names = F.inline(
        F.array(
            *(
                F.struct(F.lit(kind).alias("kind"), F.coalesce(F.col(column), F.lit(UNKNOWN)).alias("name"))
                for kind, column in (("domains", "question_name"), ("clients", "client_name"))
            )
        )
    )
    counts = kept.select("response_type", names).groupBy("kind", "name").agg(
        F.count("*").alias("n"), F.count_if(is_type("BLOCKED")).alias("blocked")
    )
    lists = F.inline(
        F.array(
            F.struct(F.col("kind").alias("list"), F.col("n").alias("count")),
            F.struct(
                F.when(F.col("kind") == "domains", "blocked_domains").alias("list"),
                F.col("blocked").alias("count"),
            ),
        )
    )
    entries = counts.select("name", lists).where(F.col("list").isNotNull() & (F.col("count") > 0))
    place = F.row_number().over(Window.partitionBy("list").orderBy(*rank_order()))
    return entries.withColumn("place", place).where(F.col("place") <= LIST_LENGTH).select("list", "name", "count")


def _sum_values(counts: str):
    return F.aggregate(F.map_values(counts), F.lit(0.0), lambda a, b: a + b)


def snapshot_overview(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Replace the parsed ``payload`` column by the overview figures.

    Rows whose payload was malformed stay, with null figures. Counts are doubles, as
    payloads may hold any number.
    """
    p = payload + "."
    keep = [c for c in payloads.columns if c != payload]
    queries, blocked = F.col(p + "summary.queries"), F.col(p + "summary.blocked")
    share = F.when(F.col(payload).isNotNull(), percentage(blocked, queries))
    return payloads.select(
        *keep,
        queries.alias("total_queries"),
        blocked.alias("blocked"),
        F.col(p + "summary.dropped").alias("dropped"),
        F.col(p + "summary.errors").alias("errors"),
        share.alias("blocked_percentage"),
        (F.col(p + "summary.cacheHitRate") * 100).alias("cache_hit_rate"),
        _sum_values(p + "lists.denylist").alias("listed_domains"),
        F.col(p + "summary.avgResponseMs").alias("avg_response_ms"),
        F.col(p + "cache.entries").alias("cache_entries"),
        F.size(F.map_keys(p + "lists.denylist")).alias("denylist_groups"),
        _sum_values(p + "lists.allowlist").alias("allowlist_domains"),
    )


def payload_top_lists(
    payloads: DataFrame, payload: str = "payload", length: int | None = None
) -> DataFrame:
    """The payload's own ranked lists as rows ``list, position, name, count``.

    Lists are whole unless ``length`` cuts them.
    """
    keep = [c for c in payloads.columns if c != payload]
    p = payload + "."
    lists = {
        "domains": p + "topDomains",
        "blocked_domains": p + "topBlockedDomains",
        "clients": p + "topClients",
    }
    entries = F.array(
        *(
            F.struct(
                F.lit(name).alias("list"),
                (F.col(path) if length is None else F.slice(path, 1, length)).alias("entries"),
            )
            for name, path in lists.items()
        )
    )
    return (
        payloads.select(*keep, F.explode(entries).alias("_list"))
        .select(*keep, "_list.list", F.posexplode("_list.entries").alias("position", "_entry"))
        .select(
            *keep,
            "list",
            (F.col("position") + 1).alias("position"),
            F.col("_entry.name").alias("name"),
            F.col("_entry.count").alias("count"),
        )
    )
