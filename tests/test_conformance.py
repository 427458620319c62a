"""The same questions to the same log, kept in every kind of source."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from seed import AS_OF, containing, of_kind, ranked, seed_rows, within

from querylog import QueryLog, write_table
from querylog.schema import TIME_RANGES
from querylog.sources.tsv import TSV_FIELDS

KINDS = ["wall-clock", "csv", "csv-client", "console", "table"]


def _iso(row):
    return row["request_ts"].strftime("%Y-%m-%dT%H:%M:%S.000Z")


def _tsv(row):
    values = {**row, "request_ts": _iso(row)}
    return "\t".join("" if values[f] is None else str(values[f]) for f in TSV_FIELDS)


def _json(row):
    names = {
        "client_names": "client_name",
        "response_reason": "reason",
        **{
            n: n
            for n in (
                "client_ip duration_ms question_name answer response_code response_type "
                "question_type"
            ).split()
        },
    }
    record = {k: "" if row[v] is None else str(row[v]) for k, v in names.items()}
    return json.dumps({"_time": _iso(row), "_msg": "seed", "prefix": "queryLog", **record})


@pytest.fixture(scope="module", params=KINDS)
def log(request, spark, seed_log, tmp_path_factory):
    kind, folder = request.param, tmp_path_factory.mktemp("source")
    rows = seed_rows()
    if kind == "wall-clock":
        wall = seed_log.withColumn("request_ts", F.col("request_ts").cast("timestamp_ntz"))
        return QueryLog(wall, AS_OF)
    if kind == "csv":
        (folder / "queries.log").write_text("\n".join(map(_tsv, reversed(rows))) + "\n")
    elif kind == "csv-client":
        for client in {r["client_name"] for r in rows}:
            mine = [_tsv(r) for r in rows if r["client_name"] == client]
            (folder / f"2024-06-15_{client or 'none'}.log").write_text("\n".join(mine))
    elif kind == "console":
        lines = [_json(r) for r in rows]
        lines.append(json.dumps({"_time": _iso(rows[0]), "_msg": "up", "prefix": "server"}))
        (folder / "export.json").write_text("\n".join(lines))
    elif kind == "table":
        write_table(seed_log, f"{folder}/t")
        return QueryLog.open(spark, "table", f"{folder}/t", AS_OF)
    return QueryLog.open(spark, kind, str(folder), AS_OF)


def _tuples(frame):
    return [tuple(r) for r in frame.collect()]


ALL = seed_rows()
N = len(ALL)


def test_log_pages(log):
    page = log.query_logs(limit=100)
    items = page.items.collect()
    assert page.totals.first()["total_count"] == len(items) == N
    times = [r["request_ts"] for r in items]
    assert times == sorted(times, reverse=True)
    first, second = log.query_logs(limit=2), log.query_logs(limit=2, offset=2)
    assert [r["request_ts"] for r in first.items.collect() + second.items.collect()] == times[:4]
    past = log.query_logs(limit=10, offset=N + 15)
    assert past.items.count() == 0 and past.totals.first()["total_count"] == N


@pytest.mark.parametrize(
    "filters, expected",
    [
        ({"response_type": "BLOCKED"}, of_kind(ALL, "BLOCKED")),
        ({"response_type": "CACHED"}, of_kind(ALL, "CACHED")),
        ({"client": "desk"}, containing(ALL, "client_name", "desk")),
        ({"question_type": "AAAA"}, [r for r in ALL if r["question_type"] == "AAAA"]),
        ({"question_type": "MX"}, []),
        ({"search": "MAIL"}, containing(ALL, "question_name", "mail")),
        ({"search": "unknown"}, []),
        ({"client": "unknown"}, []),
        ({"search": "%"}, []),
        ({"search": "m_il"}, []),
        ({"response_type": "BLOCKED", "client": "TABLET"}, of_kind(containing(ALL, "client_name", "tablet"), "BLOCKED")),
        ({"search": "", "client": None}, ALL),
    ],
)
def test_log_filters(log, filters, expected):
    page = log.query_logs(limit=100, **filters)
    assert page.totals.first()["total_count"] == len(expected)
    assert page.items.count() == len(expected)


def test_stats(log):
    day = within("24h")
    assert log.stats_24h().first().asDict() == {"total_queries": len(day), "blocked": len(of_kind(day, "BLOCKED"))}


@pytest.mark.parametrize("range", ["1h", "24h", "7d", "30d"])
def test_series_sums(log, range):
    rows = within(range)
    counts = (len(rows), len(of_kind(rows, "BLOCKED")), len(of_kind(rows, "CACHED")))
    sums = [F.sum(c) for c in ("total", "blocked", "cached")]
    buckets = TIME_RANGES[range].buckets
    for mode, n in (("aligned", buckets + 1), ("anchored", buckets)):
        series = log.queries_over_time(range, mode=mode)
        assert _tuples(series.agg(F.count("*"), *sums)) == [(n, *counts)]
    domain = log.queries_over_time(range, domain="Wiki").agg(F.sum("total"))
    client = log.queries_over_time(range, client="TABLET").agg(F.sum("total"))
    assert domain.first()[0] == len(containing(rows, "question_name", "wiki"))
    assert client.first()[0] == len(containing(rows, "client_name", "tablet"))


def _rounded(frame):
    return [(*r[:-1], round(r[-1], 3)) for r in _tuples(frame)]


@pytest.mark.parametrize("kind, column", [("domains", "question_name"), ("clients", "client_name")])
def test_top_lists(log, kind, column):
    rows = within("30d")
    page = log.top_list(kind, "30d", limit=100)
    assert _rounded(page.items) == ranked(rows, column)
    assert _tuples(page.totals) == [(len(ranked(rows, column)), len(rows), len(of_kind(rows, "BLOCKED")))]
    blocked = log.top_list(kind, "30d", filter="blocked")
    assert _rounded(blocked.items) == ranked(of_kind(rows, "BLOCKED"), column)[:10]
    assert blocked.totals.first()["total_count"] == len(ranked(of_kind(rows, "BLOCKED"), column))


def test_top_list_names(log):
    assert log.top_domains("30d").items.columns == ["domain", "count", "blocked", "percentage"]
    assert log.top_clients("30d").items.columns == ["client", "total", "blocked", "percentage"]


def test_top_list_pages(log):
    whole = _tuples(log.top_list("domains", "30d", limit=100).items)
    pages = [log.top_list("domains", "30d", limit=2, offset=o) for o in (0, 2, 4)]
    assert [row for page in pages for row in _tuples(page.items)] == whole
    past = log.top_list("domains", "30d", limit=10, offset=16)
    assert past.items.count() == 0
    assert past.totals.first()["total_count"] == len(whole)


def test_query_types(log):
    rows = within("30d")
    expected = ranked([{**r, "response_type": None} for r in rows], "question_type")
    assert _rounded(log.query_types_breakdown("30d")) == [(name, n, share) for name, n, _, share in expected]


def test_search(log):
    rows = within("30d")

    def found(column, text, limit=10):
        return [r[:2] for r in ranked(containing(rows, column, text), column)][:limit]

    assert _tuples(log.search_domains("30d", "EXAMPLE")) == found("question_name", "example")
    assert _tuples(log.search_domains("30d", "cdn.test")) == found("question_name", "cdn.test")
    assert _tuples(log.search_domains("30d", "e", limit=2)) == found("question_name", "e", 2)
    assert _tuples(log.search_clients("30d", "DESK")) == found("client_name", "desk")
    assert _tuples(log.search_clients("30d", "t", limit=1)) == found("client_name", "t", 1)
    for blank in ("", "  "):
        assert log.search_domains("30d", blank).count() == 0
        assert log.search_clients("30d", blank).count() == 0


def test_suggestions(log):
    rows = within("30d")
    top = [("domain", *r[:2]) for r in ranked(rows, "question_name")[:5]]
    top += [("client", *r[:2]) for r in ranked(rows, "client_name")[:5]]
    assert _tuples(log.suggestions(range="30d")) == top
    typed = [("domain", *r[:2]) for r in ranked(containing(rows, "question_name", "t"), "question_name")]
    typed += [("client", *r[:2]) for r in ranked(containing(rows, "client_name", "t"), "client_name")]
    assert _tuples(log.suggestions("t", range="30d")) == typed
