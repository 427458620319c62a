"""What the plans must look like to hold on large logs."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry_point
from seed import AS_OF

from querylog.plans.registered import QUERIES as REGISTERED

SF_DIR = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
QUERIES = {n: q for n, q in entry_point.queries().items() if n in REGISTERED}


def _plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def _final_plan(frame) -> str:
    frame.collect()
    return _plan(frame)


@pytest.mark.parametrize("name", ["top_domains_with_totals", "query_types_breakdown"])
def test_grouped_log_is_shuffled_once(spark, name):
    plan = _final_plan(QUERIES[name](spark, SF_DIR))
    assert plan.count("ReusedExchange") >= 1
    assert "Window" not in plan


@pytest.mark.parametrize("offset", [0, 1_000])
def test_items_and_totals_scan_the_log_once(spark, seed_log, offset, tmp_path):
    """Also past the end."""
    from querylog.operators.ranking import top_list_rows

    seed_log.write.parquet(f"{tmp_path}/log")
    stored = spark.read.parquet(f"{tmp_path}/log")
    frame = top_list_rows(stored, "domains", "30d", offset=offset, as_of=AS_OF)
    plan = _final_plan(frame).split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1


def test_snapshot_lists_come_from_one_pass(spark):
    plan = _final_plan(QUERIES["snapshot_top_lists"](spark, SF_DIR)).split("== Initial Plan ==")[0]
    assert plan.count("WindowGroupLimit") == 2 and plan.count("events.parquet") <= 2


@pytest.mark.parametrize(
    "name", ["query_logs_page", "query_logs_deep_page", "top_domains_with_totals", "search_domains"]
)
def test_pages_are_top_k(spark, name):
    plan = _plan(QUERIES[name](spark, LARGER))
    assert "TakeOrderedAndProject" in plan
    assert not re.search(r"Exchange rangepartitioning", plan)


@pytest.mark.parametrize(
    "name", ["stats_24h", "top_domains_with_totals", "queries_over_time_24h", "filter_time_range"]
)
def test_time_bound_reaches_the_scan(spark, name):
    assert "GreaterThanOrEqual(ts," in _plan(QUERIES[name](spark, SF_DIR))


def test_pages_read_their_hours_only(spark):
    plan = _plan(QUERIES["query_logs_deep_page"](spark, LARGER))
    assert "GreaterThanOrEqual(ts," in plan and "LessThan(ts," in plan


def test_columns_are_pruned(spark):
    plan = _plan(QUERIES["stats_24h"](spark, SF_DIR))
    assert re.findall(r"ReadSchema: struct<(.*?)>", plan) == [
        "ts:timestamp_ntz,event_type:string"
    ]


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith("queries_over_time")])
def test_series_shuffle_counts_only(spark, name):
    plan = _plan(QUERIES[name](spark, SF_DIR))
    assert "partial_count" in plan
    assert plan.count("Exchange hashpartitioning") == 1
    assert "rangepartitioning" not in plan and "SortMergeJoin" not in plan


def test_rank_within_bucket_is_cut_before_the_shuffle(spark):
    plan = _plan(QUERIES["windowed_top_domains_daily"](spark, SF_DIR))
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", QUERIES)
def test_no_python_in_the_plan(spark, name):
    plan = _plan(QUERIES[name](spark, SF_DIR))
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


def test_lines_and_records_are_parsed_once(spark, seed_log):
    from querylog.sources.jsonl import parse_jsonl_lines
    from querylog.sources.tsv import parse_tsv_lines

    lines = seed_log.selectExpr("answer AS value")
    assert _plan(parse_tsv_lines(lines)).count("split(") == 1
    assert _plan(parse_jsonl_lines(lines)).count("from_json(") == 1


def test_pages_of_a_stored_log_prune_dates(spark, seed_log, tmp_path):
    from querylog import QueryLog, write_table

    write_table(seed_log, f"{tmp_path}/t")
    log = QueryLog.open(spark, "table", f"{tmp_path}/t")
    page = log.query_logs(limit=2, offset=30).items
    plan = _plan(page)
    assert re.search(r"\(request_date#\d+ >= ", plan) and re.search(r"\(request_date#\d+ <= ", plan)
    assert "GreaterThanOrEqual(request_ts," in plan and "LessThan(request_ts" in plan
    assert page.count() == 2


@pytest.mark.parametrize("name", ["parse_tsv_lines", "tsv_rejects"])
def test_lines_are_built_once(spark, name):
    plan = _final_plan(QUERIES[name](spark, SF_DIR)).split("== Initial Plan ==")[0]
    assert plan.count("concat_ws(") == 1


@pytest.mark.parametrize("name", ["suggestions_blank", "suggestions_typed"])
def test_suggestions_come_from_one_pass(spark, name):
    plan = _final_plan(QUERIES[name](spark, SF_DIR)).split("== Initial Plan ==")[0]
    assert 1 <= plan.count("FileScan") <= 3 and plan.count("WindowGroupLimit") == 2  # at most one of each table
