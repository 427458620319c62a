"""Pages at any depth against a plain sort in Python."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from querylog.operators import paging
from querylog.operators.logs import query_logs
from querylog.operators.ranking import top_list
from querylog.schema import LOG_SCHEMA

N = 3000
START = datetime(2024, 1, 1)


def _rows():
    """A third of all rows share one second and one domain, some have no time."""
    pick = random.Random(7)
    rows = []
    for i in range(N):
        if i % 3 == 0:
            ts, name = START + timedelta(days=2), "hot.example"
        elif i % 50 == 1:
            ts, name = None, f"d{i % 5}.example"
        else:
            ts = START + timedelta(seconds=pick.randrange(5 * 86400), microseconds=i)
            name = pick.choice([None, f"d{pick.randrange(400)}.example", f"D{i % 9}.example"])
        rows.append((i, ts, name, f"c{pick.randrange(700)}", pick.choice(["BLOCKED", "CACHED"])))
    return rows


ROWS = _rows()


@pytest.fixture(scope="module", params=["timestamp", "timestamp_ntz"])
def log(request, spark):
    small = spark.createDataFrame(
        ROWS,
        "id long, request_ts timestamp, question_name string, client_name string, "
        "response_type string",
    ).repartition(5)
    ts = F.col("request_ts").cast(request.param).alias("request_ts")
    known = {"request_ts": ts}
    cols = [
        known.get(f.name, F.col(f.name) if f.name in small.columns else F.lit(None).cast(f.dataType))
        .alias(f.name)
        for f in LOG_SCHEMA
    ]
    return small.select(*cols).cache()


def _newest_first(rows):
    rows = sorted(rows, key=lambda r: (r[2] is not None, r[2] or "", r[0]))
    return sorted(rows, key=lambda r: r[1] or datetime.min, reverse=True)


ORDERED = [r[0] for r in _newest_first(ROWS)]


@pytest.fixture(params=[40, 1000])
def top_k(request, monkeypatch):
    monkeypatch.setattr(paging, "TOP_K_ROWS", request.param)


@pytest.mark.parametrize("limit, offset", [(10, 0), (100, 1700), (7, N - 5), (10, N)])
def test_log_pages(log, top_k, limit, offset):
    page = query_logs(log, limit=limit, offset=offset)
    assert [r["id"] for r in page.items.collect()] == ORDERED[offset : offset + limit]
    assert page.totals.first()["total_count"] == N


def test_filtered_deep_page(log, top_k):
    page = query_logs(log, limit=50, offset=400, response_type="BLOCKED", search="HOT")
    kept = {r[0] for r in ROWS if r[4] == "BLOCKED" and r[2] == "hot.example"}
    expected = [i for i in ORDERED if i in kept]
    assert [r["id"] for r in page.items.collect()] == expected[400:450]
    assert page.totals.first()["total_count"] == len(expected)


def _ranked(column):
    counts = {}
    for row in ROWS:
        if row[1] is not None:
            name = row[column] or "unknown"
            counts[name] = counts.get(name, 0) + 1
    return sorted(counts.items(), key=lambda kv: (-kv[1], kv[0].lower(), kv[0]))


@pytest.mark.parametrize("kind, column", [("domains", 2), ("clients", 3)])
@pytest.mark.parametrize("offset", [0, 330, 2000])
def test_ranked_pages(log, top_k, kind, column, offset):
    page = top_list(
        log, kind, "30d", limit=40, offset=offset, as_of=START + timedelta(days=10)
    )
    expected = _ranked(column)
    found = [(r["name"], r["count"]) for r in page.items.collect()]
    assert found == expected[offset : offset + 40]
    assert page.totals.first()["total_count"] == len(expected)
    total = sum(n for _, n in expected)
    for row in page.items.collect():
        assert row["percentage"] == row["count"] / total * 100


@pytest.mark.parametrize("moment", [datetime(1, 1, 1, 5), datetime(9999, 12, 31, 23, 59, 59)])
def test_ends_of_the_calendar(spark, monkeypatch, moment):
    monkeypatch.setattr(paging, "TOP_K_ROWS", 1)
    rows = [(i, START if i % 2 else moment) for i in range(6)]
    small = spark.createDataFrame(rows, "id long, request_ts timestamp")
    cols = [
        (F.col(f.name) if f.name in small.columns else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in LOG_SCHEMA
    ]
    page = query_logs(small.select(*cols), limit=2, offset=2)
    order = sorted(rows, key=lambda r: r[0])
    order = sorted(order, key=lambda r: r[1], reverse=True)
    found = page.items.select("id").collect()
    assert [r["id"] for r in found] == [r[0] for r in order[2:4]]


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    sizes=st.lists(st.integers(1, 40), min_size=1, max_size=8),
    limit=st.integers(1, 30),
    offset=st.integers(0, 150),
)
def test_page_by_splitting(spark, sizes, limit, offset):
    values = [(k, f"t{i % 7}") for k, size in enumerate(sizes) for i in range(size)]
    frame = spark.createDataFrame(values, "k int, t string").repartition(4)
    expected = sorted(values, key=lambda v: (-v[0], v[1]))[offset : offset + limit]
    before = paging.TOP_K_ROWS, paging.SPLITTERS
    paging.TOP_K_ROWS, paging.SPLITTERS = 3, 5
    try:
        page = paging.page_of(frame, [-F.col("k"), F.col("t")], [F.desc("k"), F.asc("t")], limit, offset)
        assert [tuple(r) for r in page.collect()] == expected
    finally:
        paging.TOP_K_ROWS, paging.SPLITTERS = before


def test_names_with_one_beginning_take_no_single_task(spark):
    """Millions of names of count 1 with a long common beginning, in small."""
    n = 40_000
    name = F.concat(F.lit("a-rather-long-common-beginning."), F.lpad(F.col("id").cast("string"), 6, "0"))
    frame = spark.range(0, n, 1, 8).select(F.when(F.col("id") % 10 == 0, None).otherwise(name).alias("name"), (F.col("id") % 2).alias("n"))
    plans = []
    collect = type(frame).collect

    def seen(self):
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return collect(self)

    type(frame).collect = seen
    try:
        page = paging.page_of(frame, [-F.col("n"), F.col("name")], [F.desc("n"), F.asc_nulls_first("name")], 20, 30_011)
        found = [r["name"] for r in page.collect()]
    finally:
        type(frame).collect = collect
    rows = sorted((-(i % 2), i % 10 != 0, i) for i in range(n))[30_011:30_031]
    assert [f and int(f[-6:]) for f in found] == [i if named else None for _, named, i in rows]
    assert len(plans) <= 7 and not any("Window" in p for p in plans)


def test_ranked_rows_are_lazy_or_refused(spark, log):
    """The one frame runs nothing before it is read, or says that it cannot."""
    from querylog.operators.ranking import top_list_rows

    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "lazy")
    try:
        for offset in (0, 900, paging.TOP_K_ROWS):
            top_list_rows(log, "clients", "30d", offset=offset, as_of=START)
        assert not tracker.getJobIdsForGroup("lazy")
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
    with pytest.raises(ValueError, match="top_list"):
        top_list_rows(log, "clients", "30d", offset=paging.TOP_K_ROWS + 1, as_of=START)


@pytest.mark.parametrize("offset", [0, 5000])
def test_pages_behave_alike_at_any_offset(spark, log, offset, tmp_path):
    """Neither needs a folder, writes, or leaves anything behind; ranked pages come whole."""
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = sorted(folder.glob("*"))
    query_logs(log, limit=10, offset=offset).items.collect()
    page = top_list(log, "clients", "30d", offset=offset, as_of=START + timedelta(days=10))
    assert "InMemoryTableScan" not in page.items._jdf.queryExecution().executedPlan().toString()
    assert sorted(folder.glob("*")) == before


def test_pages_of_a_log_without_ids(spark, top_k):
    """A third of the rows are copies, a third differ in the client only."""
    rows = [
        (START, "hot", "c" if i % 3 == 0 else f"c{i}") if i % 3 < 2 else (None, f"d{i}", None)
        for i in range(240)
    ]
    small = spark.createDataFrame(
        rows, "request_ts timestamp, question_name string, client_name string"
    ).repartition(4)
    cols = [
        (F.col(f.name) if f.name in small.columns else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in LOG_SCHEMA
    ]
    log = small.select(*cols).cache()
    found = []
    for offset in range(0, 240, 60):
        page = query_logs(log, limit=60, offset=offset).items
        found += [tuple(r) for r in page.select(*small.columns).collect()]
    dated = sorted(r for r in rows if r[0])
    assert found == dated + sorted((r for r in rows if not r[0]), key=lambda r: r[1])
