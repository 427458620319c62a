"""Ranked lists of domains and clients, breakdowns and substring search."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querylog.functions.display import percentage
from querylog.functions.predicates import (
    blocked_only,
    contains_text,
    in_range,
    is_type,
    where_all,
)
from querylog.operators.rollup import Rollup, rolled_names
from querylog.operators.paging import TOP_K_ROWS, Page, page_of, top_page
from querylog.schema import UNKNOWN
from querylog.validation import (
    LIST_KINDS,
    LIST_PAGE_DEFAULT,
    SEARCH_DEFAULT,
    check_choice,
    check_page,
    check_search,
)

# Kind of list: log column, name of the ranked column, name of its row count.
_KINDS = {
    "domains": ("question_name", "domain", "count"),
    "clients": ("client_name", "client", "total"),
}


def rank_order(name: str = "name", count: str = "count") -> list[Column]:
    """Most rows first; ties by lower-cased name, then by name."""
    return [F.desc(count), F.lower(F.col(name)), F.col(name)]


def grouped_counts(log: DataFrame, column: str, at_source: bool = False) -> DataFrame:
    """Rows and blocked rows per name. Nulls are one group, named "unknown".

    Partial aggregation leaves at most one row per name and task to shuffle, so
    a name holding a large part of the log costs no more than a rare one.

    ``at_source`` counts in a form that databases take: sums of cases over groups of the
    bare column. The nulls are named, and joined to an equal name, after that.
    """
    if at_source:
        blocked = F.sum(F.when(is_type("BLOCKED"), 1).otherwise(0))
        stored = log.groupBy(column).agg(F.count("*").alias("count"), blocked.alias("blocked"))
        return stored.groupBy(F.coalesce(F.col(column), F.lit(UNKNOWN)).alias("name")).agg(
            F.sum("count").alias("count"), F.sum("blocked").alias("blocked")
        )
    return log.groupBy(F.coalesce(F.col(column), F.lit(UNKNOWN)).alias("name")).agg(
        F.count("*").alias("count"),
        F.count_if(is_type("BLOCKED")).alias("blocked"),
    )


def group_totals(grouped: DataFrame) -> DataFrame:
    """One row: number of groups, rows, and blocked rows."""
    return grouped.agg(
        F.count("*").alias("total_count"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("total_queries"),
        F.coalesce(F.sum("blocked"), F.lit(0)).alias("total_blocked"),
    )


_TOTALS = ("total_count", "total_queries", "total_blocked")


def _rank_page(grouped: DataFrame, limit: int, offset: int) -> DataFrame:
    keys = [-F.col("count"), F.lower(F.col("name")), F.col("name")]
    return page_of(grouped, keys, rank_order(), limit, offset)


def _list_rows(
    log: DataFrame, kind: str, range: str, limit: int, offset: int, filter: str, as_of: datetime | None, at_source: bool,
    rollup: Rollup | None = None,
) -> DataFrame:
    check_choice("kind", kind, LIST_KINDS)
    check_page(limit, offset)
    only = blocked_only(filter)
    if rollup is not None:
        grouped = rolled_names(log, rollup, kind, range, as_of, filter)
    else:
        grouped = grouped_counts(where_all(log, [in_range(log, range, as_of), *only]), _KINDS[kind][0], at_source)
    page = _rank_page(grouped, limit, offset)
    share = percentage(F.col("count"), F.col("total_queries"))
    both = F.broadcast(group_totals(grouped)).join(page, F.lit(True), "left")
    return both.select("name", "count", "blocked", share.alias("percentage"), *_TOTALS)


def top_list_rows(
    log: DataFrame,
    kind: str,
    range: str,
    limit: int = LIST_PAGE_DEFAULT,
    offset: int = 0,
    filter: str = "all",
    as_of: datetime | None = None,
    at_source: bool = False,
) -> DataFrame:
    """One frame with a page's rows and, in every row, the totals over all pages.

    Past the end there is one row, of totals alone. Page and totals read the same
    exchange of the grouped log, so a page costs one pass. Nothing runs before the frame
    is read; so it offers the first thousand ranks, for deeper pages have to be located
    first: see :func:`top_list`. ``at_source`` is for frames of a database (see
    :func:`querylog.sources.open_database`), which then counts.
    """
    if offset > TOP_K_ROWS:
        raise ValueError(f"top_list_rows offers offsets up to {TOP_K_ROWS}; top_list has all")
    return _list_rows(log, kind, range, limit, offset, filter, as_of, at_source)


def top_list(
    log: DataFrame,
    kind: str,
    range: str,
    limit: int = LIST_PAGE_DEFAULT,
    offset: int = 0,
    filter: str = "all",
    as_of: datetime | None = None,
    at_source: bool = False,
    rollup: Rollup | None = None,
) -> Page:
    """Ranked names with columns ``name, count, blocked, percentage``, and totals.

    With ``filter="blocked"`` percentages are of the blocked rows. Past the end the
    totals still tell the number of groups. The page, at most a hundred rows, and its
    totals are computed when this is called; a deep page is located by passes over
    the grouped log before. :func:`top_list_rows` is the same as one frame. With a
    ``rollup`` of the log its counts are added up instead of the log's rows.
    """
    spark = log.sparkSession
    frame = _list_rows(log, kind, range, limit, offset, filter, as_of, at_source, rollup)
    rows = frame.collect()
    names = [c for c in frame.columns if c not in _TOTALS]
    items = spark.createDataFrame(
        [tuple(r[c] for c in names) for r in rows if r["name"] is not None], frame.select(*names).schema
    )
    totals = spark.createDataFrame([tuple(rows[0][c] for c in _TOTALS)], frame.select(*_TOTALS).schema)
    return Page(items.orderBy(*rank_order()), totals)


def _renamed(page: Page, kind: str) -> Page:
    _, name, count = _KINDS[kind]
    items = page.items.select(
        F.col("name").alias(name), F.col("count").alias(count), "blocked", "percentage"
    )
    return Page(items, page.totals)


def top_domains(log: DataFrame, range: str, **options) -> Page:
    """:func:`top_list` of domains as ``domain, count, blocked, percentage``."""
    return _renamed(top_list(log, "domains", range, **options), "domains")


def top_clients(log: DataFrame, range: str, **options) -> Page:
    """:func:`top_list` of clients as ``client, total, blocked, percentage``."""
    return _renamed(top_list(log, "clients", range, **options), "clients")


def query_types_breakdown(
    log: DataFrame, range: str, as_of: datetime | None = None, at_source: bool = False, rollup: Rollup | None = None
) -> DataFrame:
    """Rows and percentage per record type, most frequent first."""
    if rollup is not None:
        counts = rolled_names(log, rollup, "types", range, as_of)
    else:
        kept, named = log.where(in_range(log, range, as_of)), F.coalesce("question_type", F.lit(UNKNOWN)).alias("name")
        if at_source:  # databases take groups of the bare column
            stored = kept.groupBy("question_type").agg(F.count("*").alias("count"))
            counts = stored.groupBy(named).agg(F.sum("count").alias("count"))
        else:
            counts = kept.groupBy(named).agg(F.count("*").alias("count"))
    types = counts.select(F.col("name").alias("type"), "count")
    total = types.agg(F.sum("count").alias("total_queries"))
    return (
        types.crossJoin(F.broadcast(total))
        .select(
            "type", "count", percentage(F.col("count"), F.col("total_queries")).alias("percentage")
        )
        .orderBy(*rank_order("type"))
    )


def _search(
    log: DataFrame, kind: str, range: str, query: str, limit: int, as_of: datetime | None, rollup: Rollup | None
) -> DataFrame:
    check_search(limit)
    column, name, _ = _KINDS[kind]
    if rollup is not None:
        found = rolled_names(log, rollup, kind, range, as_of, containing=query)
        return top_page(found.select(F.col("name").alias(name), "count"), rank_order(name), limit, 0)
    hit = contains_text(column, query) if query.strip() else F.lit(False)
    return top_page(
        log.where(in_range(log, range, as_of) & hit)
        .groupBy(F.col(column).alias(name))
        .agg(F.count("*").alias("count")),
        rank_order(name),
        limit,
        0,
    )


def search_domains(
    log: DataFrame,
    range: str,
    query: str,
    limit: int = SEARCH_DEFAULT,
    as_of: datetime | None = None,
    rollup: Rollup | None = None,
) -> DataFrame:
    """Most frequent domains containing ``query``; a blank query finds nothing."""
    return _search(log, "domains", range, query, limit, as_of, rollup)


def search_clients(
    log: DataFrame,
    range: str,
    query: str,
    limit: int = SEARCH_DEFAULT,
    as_of: datetime | None = None,
    rollup: Rollup | None = None,
) -> DataFrame:
    """Most frequent clients containing ``query``; a blank query finds nothing."""
    return _search(log, "clients", range, query, limit, as_of, rollup)


# Suggestions shown before and while typing.
_SUGGESTED_TOP = 5
_SUGGESTED_HITS = 10


def suggestions(
    log: DataFrame, text: str = "", range: str = "24h", as_of: datetime | None = None
) -> DataFrame:
    """Filter suggestions ``kind, name, count``: the top names while nothing is
    typed, otherwise the names containing the typed text.

    One pass: each row gives its domain and its client, and names are cut to the first
    of each kind before they are shuffled for ranking.
    """
    most, named = (_SUGGESTED_HITS if text else _SUGGESTED_TOP), []
    for kind in LIST_KINDS:
        column, name, _ = _KINDS[kind]
        if not text:
            hit, value = F.lit(True), F.coalesce(F.col(column), F.lit(UNKNOWN))
        else:
            hit, value = (contains_text(column, text) if text.strip() else F.lit(False)), F.col(column)
        named.append(F.when(hit, F.struct(F.lit(name).alias("kind"), value.alias("name"))))
    kept = log.where(in_range(log, range, as_of)).select(F.explode(F.array(*named)).alias("hit"))
    counts = kept.where("hit IS NOT NULL").groupBy("hit.kind", "hit.name").agg(F.count("*").alias("count"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(*rank_order()))
    kept = counts.withColumn("place", place).where(F.col("place") <= most)
    return kept.orderBy(F.desc("kind"), "place").limit(len(named) * most).drop("place")  # domains first


def list_shares(items: DataFrame) -> DataFrame:
    """Bar lengths for one page of a top list: each row in percent of the page's
    largest, and its blocked rows in percent of its own.

    The window spans the page, at most a hundred rows.
    """
    largest = F.max("count").over(Window.partitionBy())
    width = percentage(F.col("count"), largest)
    blocked = percentage(F.col("blocked"), F.col("count"))
    return items.select(
        "*",
        width.alias("width"),
        blocked.alias("blocked_percentage"),
        (width * (1 - blocked / 100)).alias("allowed_width"),
        (width * (blocked / 100)).alias("blocked_width"),
    )


def page_info(totals: DataFrame, limit: int, offset: int) -> DataFrame:
    """Number of pages and the first and last row shown on this one."""
    check_page(limit, offset)
    total = F.col("total_count")
    return totals.select(
        total,
        F.ceil(total / F.lit(limit)).cast("long").alias("total_pages"),
        F.lit(offset + 1).cast("long").alias("first_row"),
        F.least(F.lit(offset + limit).cast("long"), total).alias("last_row"),
    )
