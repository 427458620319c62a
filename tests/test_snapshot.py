"""Statistics payloads and the figures derived from them."""

from __future__ import annotations

import json

import pytest
from seed import AS_OF, of_kind, ranked, within

from querylog.operators.snapshot import (
    overview_24h,
    payload_top_lists,
    snapshot_overview,
    snapshot_top_lists,
)
from querylog.sources.payloads import parse_payloads


def payload(indent=None, **changes):
    document = {
        "summary": {
            "queries": 640,
            "blocked": 96.0,
            "dropped": 2.5,
            "errors": 3,
            "avgResponseMs": 21.5,
            "cacheHitRate": 0.3125,
        },
        "topDomains": [{"name": f"n{i}.test", "count": 90 - 7 * i} for i in range(9)],
        "topBlockedDomains": [{"name": "beacon.invalid", "count": 61.0}, {"name": "pixel.invalid", "count": 35}],
        "topClients": [{"name": "tablet", "count": 333}],
        "lists": {"denylist": {"a": 41, "b": 9.0, "c": 2500}, "allowlist": {"own": 12}},
        "cache": {"entries": 870.0},
        "uptime": "3 days",
        "history": [],
    }
    return json.dumps({**document, **changes}, indent=indent)


def _parsed(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc int, text string")
    return parse_payloads(rows, "text")


def test_overview(spark):
    row = snapshot_overview(_parsed(spark, payload())).first().asDict()
    assert row == {
        "doc": 0,
        "total_queries": 640.0,
        "blocked": 96.0,
        "dropped": 2.5,
        "errors": 3.0,
        "blocked_percentage": 15.0,
        "cache_hit_rate": 31.25,
        "listed_domains": 2550.0,
        "avg_response_ms": 21.5,
        "cache_entries": 870.0,
        "denylist_groups": 3,
        "allowlist_domains": 12.0,
    }


def test_no_queries(spark):
    summary = dict.fromkeys(
        ("queries", "blocked", "dropped", "errors", "avgResponseMs", "cacheHitRate"), 0
    )
    row = snapshot_overview(_parsed(spark, payload(summary=summary))).first()
    assert row["blocked_percentage"] == 0.0


@pytest.mark.parametrize(
    "text",
    [
        '{"summary": {}}',
        "{broken",
        "",
        "[]",
        payload(cache=None),
        payload(lists={"denylist": {"ads": "many"}, "allowlist": {}}),
        payload(topClients=[{"name": "laptop"}]),
        payload(topDomains=None),
    ],
)
def test_malformed(spark, text):
    row = snapshot_overview(_parsed(spark, text)).first().asDict()
    assert row.pop("doc") == 0
    assert set(row.values()) == {None}


def test_empty_lists_are_well_formed(spark):
    text = payload(topDomains=[], lists={"denylist": {}, "allowlist": {}})
    row = snapshot_overview(_parsed(spark, text)).first()
    assert (row["listed_domains"], row["denylist_groups"], row["allowlist_domains"]) == (0, 0, 0)


def test_payload_lists(spark):
    rows = payload_top_lists(_parsed(spark, payload(), "{}")).collect()
    domains = [(r["position"], r["name"], r["count"]) for r in rows if r["list"] == "domains"]
    assert domains == [(i + 1, f"n{i}.test", 90 - 7 * i) for i in range(9)]
    assert len(rows) == 12
    assert payload_top_lists(_parsed(spark, payload()), length=4).count() == 7


def test_log_overview(seed_log):
    day = within("24h")
    blocked, cached, forwarded = (len(of_kind(day, k)) for k in ("BLOCKED", "CACHED", "RESOLVED"))
    row = overview_24h(seed_log, AS_OF).first().asDict()
    assert (row["total_queries"], row["blocked"], row["cached"], row["forwarded"]) == (len(day), blocked, cached, forwarded)
    assert row["blocked_percentage"] == pytest.approx(100 * blocked / len(day))
    assert row["cache_hit_rate"] == pytest.approx(cached / (cached + forwarded) * 100)
    times = [r["duration_ms"] for r in day if r["duration_ms"] is not None]
    assert row["avg_response_ms"] == pytest.approx(sum(times) / len(times))


def test_log_overview_of_nothing(seed_log):
    row = overview_24h(seed_log.where("false"), AS_OF).first().asDict()
    assert (row["total_queries"], row["blocked_percentage"], row["cache_hit_rate"]) == (0, 0.0, 0.0)
    assert row["avg_response_ms"] is None


def test_log_lists(seed_log):
    day = within("24h")
    expected = {("domains", *r[:2]) for r in ranked(day, "question_name")[:5]}
    expected |= {("blocked_domains", *r[:2]) for r in ranked(of_kind(day, "BLOCKED"), "question_name")[:5]}
    expected |= {("clients", *r[:2]) for r in ranked(day, "client_name")[:5]}
    assert {tuple(r) for r in snapshot_top_lists(seed_log, AS_OF).collect()} == expected
