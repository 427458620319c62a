"""Parameters out of bounds are refused before anything runs."""

from __future__ import annotations

import pytest

from querylog import QueryLog
from querylog.operators.ranking import list_shares, page_info
from querylog.schema import TIME_RANGES


@pytest.fixture(scope="module")
def log(seed_log):
    return QueryLog(seed_log)


@pytest.mark.parametrize(
    "call",
    [
        lambda log: log.query_logs(limit=0),
        lambda log: log.query_logs(limit=101),
        lambda log: log.query_logs(limit=2.5),
        lambda log: log.query_logs(limit=True),
        lambda log: log.query_logs(offset=-1),
        lambda log: log.query_logs(response_type="blocked"),
        lambda log: log.query_logs(question_type="PTR"),
        lambda log: log.query_logs(range="2d"),
        lambda log: log.top_domains("1w"),
        lambda log: log.top_domains("1h", limit=101),
        lambda log: log.top_clients("1h", filter="cached"),
        lambda log: log.top_clients("1h", offset=-1),
        lambda log: log.top_list("hosts", "1h"),
        lambda log: log.query_types_breakdown(""),
        lambda log: log.search_domains("1h", "x", limit=51),
        lambda log: log.search_clients("1h", "x", limit=0),
        lambda log: log.queries_over_time("1h", mode="rolling"),
        lambda log: log.queries_over_time("90d"),
    ],
)
def test_refused(log, call):
    with pytest.raises(ValueError):
        call(log)


def test_ranges():
    assert {n: r.buckets for n, r in TIME_RANGES.items()} == {
        "1h": 12,
        "24h": 24,
        "7d": 28,
        "30d": 30,
    }


def test_current_time_is_the_default(log):
    assert log.stats_24h().first()["total_queries"] == 0
    assert log.queries_over_time("1h").count() == 13


def test_shares(spark):
    items = spark.createDataFrame(
        [("a", 8, 2, 80.0), ("b", 2, 0, 20.0)],
        "name string, count long, blocked long, percentage double",
    )
    rows = [tuple(r)[4:] for r in list_shares(items).orderBy("name").collect()]
    assert rows == [(100.0, 25.0, 75.0, 25.0), (25.0, 0.0, 25.0, 0.0)]


@pytest.mark.parametrize(
    "total, limit, offset, expected",
    [(0, 10, 0, (0, 0, 1, 0)), (41, 10, 40, (41, 5, 41, 41)), (40, 10, 10, (40, 4, 11, 20))],
)
def test_page_info(spark, total, limit, offset, expected):
    totals = spark.createDataFrame([(total,)], "total_count long")
    assert tuple(page_info(totals, limit, offset).first()) == expected
