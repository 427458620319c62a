"""Answers from hourly counts equal those from the whole log."""

from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from seed import AS_OF, seed_rows

from querylog import QueryLog, read_query_log, write_table
from querylog.functions.predicates import in_range
from querylog.operators.rollup import Rollup, hourly_counts, rolled_names, rolled_series, write_rollup
from querylog.plans.fixture import fixture_log
from querylog.plans.registered import AS_OF as FIXTURE_AS_OF

SF_DIR = "/root/testdata/sf0.001"
RANGES = ("1h", "24h", "30d")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("rollup")
    log = fixture_log(spark, SF_DIR)
    named = F.when(F.col("id") % 23 == 0, "unknown").otherwise(F.col("question_name"))
    undated = log.limit(5).withColumn("request_ts", F.lit(None).cast("timestamp_ntz"))
    write_table(log.withColumn("question_name", named).unionByName(undated), f"{folder}/log")
    log = read_query_log(spark, "table", f"{folder}/log")
    write_rollup(log, f"{folder}/hours")
    return log, Rollup.open(spark, f"{folder}/hours"), folder


def _rows(frame):
    return [tuple(r) for r in frame.collect()]


# unaligned, at an hour's last microsecond, and long before the log
@pytest.mark.parametrize("as_of", [FIXTURE_AS_OF, FIXTURE_AS_OF.replace(minute=0) - timedelta(days=9, microseconds=1), FIXTURE_AS_OF - timedelta(days=60)])
def test_equals_the_full_scan(stored, as_of):
    log, rollup, _ = stored
    whole, fast = QueryLog(log, as_of), QueryLog(log, as_of, rollup=rollup)
    for kind, range_, filter in (("domains", "30d", "all"), ("clients", "24h", "blocked")):
        a, b = (q.top_list(kind, range_, limit=100, filter=filter) for q in (whole, fast))
        assert _rows(a.items) == _rows(b.items) and _rows(a.totals) == _rows(b.totals)
    assert _rows(whole.query_types_breakdown("7d")) == _rows(fast.query_types_breakdown("7d"))
    for range_ in ("24h", "30d"):
        assert _rows(whole.queries_over_time(range_)) == _rows(fast.queries_over_time(range_))


@pytest.mark.parametrize("text", ["unk", "TION", " "])
def test_search_equals_the_full_scan(stored, text):
    log, rollup, _ = stored
    whole, fast = QueryLog(log, FIXTURE_AS_OF), QueryLog(log, FIXTURE_AS_OF, rollup=rollup)
    assert _rows(whole.search_domains("7d", text, 50)) == _rows(fast.search_domains("7d", text, 50))


@pytest.mark.parametrize("range_", RANGES)
def test_the_log_is_read_at_the_edges_alone(stored, range_):
    """A log without the rows between gives the same, and its scans prune dates."""
    log, rollup, _ = stored
    frame = rolled_names(log, rollup, "domains", range_, FIXTURE_AS_OF)
    start = FIXTURE_AS_OF - {"1h": timedelta(hours=1), "24h": timedelta(days=1), "7d": timedelta(days=7), "30d": timedelta(days=30)}[range_]
    at = F.col("request_ts")
    edge = (at >= F.lit(start).cast("timestamp_ntz")) & (at < F.lit(start + timedelta(hours=1)).cast("timestamp_ntz"))
    bare = log.where(edge | (F.col("request_date") > F.lit(rollup.through)))
    assert sorted(_rows(rolled_names(bare, rollup, "domains", range_, FIXTURE_AS_OF))) == sorted(_rows(frame))
    assert bare.count() < log.count() / 2
    plan = frame._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "/log" in line]
    assert scans and all("request_date" in line.split("PartitionFilters: [")[1].split("]")[0] for line in scans)


def test_dates_are_counted_again_one_by_one(spark, seed_log, tmp_path):
    log = seed_log.cache()
    write_rollup(log, f"{tmp_path}/hours")
    before = sorted(_rows(Rollup.open(spark, f"{tmp_path}/hours").counts), key=str)
    write_rollup(log, f"{tmp_path}/hours", [AS_OF.date()])
    assert sorted(_rows(Rollup.open(spark, f"{tmp_path}/hours").counts), key=str) == before
    late = log.unionByName(log.where(F.to_date("request_ts") == F.lit(AS_OF.date() - timedelta(days=2))))
    write_rollup(late, f"{tmp_path}/hours", [AS_OF.date() - timedelta(days=2)])
    rollup = Rollup.open(spark, f"{tmp_path}/hours")
    assert rollup.through == AS_OF.date() - timedelta(days=1)
    found = rolled_names(late, rollup, "clients", "7d", AS_OF).agg(F.sum("count")).first()[0]
    assert found == late.where(in_range(late, "7d", AS_OF)).count()


def test_counts_add_up(seed_log):
    counts = hourly_counts(seed_log).groupBy("kind").agg(F.sum("count").alias("n"), F.sum("blocked").alias("b")).collect()
    assert {r["kind"]: r["n"] for r in counts} == dict.fromkeys(("domains", "clients", "types"), len(seed_rows()))
    assert len({r["b"] for r in counts}) == 1


def test_empty_rollup_and_short_buckets(spark, seed_log, tmp_path):
    write_rollup(seed_log.limit(0), f"{tmp_path}/hours")
    empty = Rollup(spark.createDataFrame([], "hour long, kind string, name string, count long, blocked long, cached long, request_date date"), None)
    whole, fast = QueryLog(seed_log, AS_OF), QueryLog(seed_log, AS_OF, rollup=empty)
    assert _rows(whole.top_domains("30d").items) == _rows(fast.top_domains("30d").items)
    assert _rows(whole.queries_over_time("1h")) == _rows(fast.queries_over_time("1h"))
    with pytest.raises(ValueError, match="shorter"):
        rolled_series(seed_log, empty, "1h", AS_OF)
