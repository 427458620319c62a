"""Reading from databases: slices, and what is asked of them. No database runs here."""

from __future__ import annotations

import random
from bisect import bisect_left
from collections import Counter
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from seed import AS_OF

from querylog import QueryLog
from querylog.operators import ranking, snapshot
from querylog.sources.jdbc import catalog_options, depth_slices, open_database, read_jdbc
from querylog.sources.slices import LEVELS, Slice, count_query, equal_depth, key_expression, planned

START = datetime(2024, 3, 1, 4, 59, 58)


def _stamps(n=4_000, separator=" "):
    """Times with a quiet night, a burst within a minute and one within a second."""
    rng = random.Random(8)
    moments = [START + timedelta(seconds=rng.randrange(40 * 3600)) for _ in range(n // 2)]
    moments += [START + timedelta(hours=3, milliseconds=rng.randrange(60_000)) for _ in range(n // 4)]
    moments += [START + timedelta(hours=9, microseconds=rng.randrange(1_000_000)) for _ in range(n - len(moments))]
    return sorted(m.isoformat(separator, "microseconds") for m in moments)


class Counted:
    """Counts rows as a database would, and remembers how many keys it returned."""

    def __init__(self, stamps):
        self.stamps, self.asked, self.returned = stamps, [], 0

    def __call__(self, level, low, high):
        from_, to = bisect_left(self.stamps, low or ""), bisect_left(self.stamps, high or "~")
        found = Counter(s[: LEVELS[level]] for s in self.stamps[from_:to])
        self.asked.append((level, low, high))
        self.returned += len(found)
        return list(found.items())


def _within(piece: Slice, stamp: str) -> bool:
    return (piece.low is None or stamp >= piece.low) and (piece.high is None or stamp < piece.high)


@pytest.mark.parametrize("separator", [" ", "T"])
@pytest.mark.parametrize("rows", [50, 333, 5_000])
def test_slices_cover_once_in_equal_depth(rows, separator):
    stamps = _stamps(separator=separator)
    count = Counted(stamps)
    slices = planned(count, rows)
    for stamp in [*stamps[::7], "1970-01-01 00:00:00", "2999-01-01T00:00:00"]:
        assert sum(_within(s, stamp) for s in slices) == 1
    sizes = [sum(_within(s, stamp) for stamp in stamps) for s in slices]
    assert sizes == [s.rows for s in slices] and sum(sizes) == len(stamps)
    second = max(Counter(s[:19] for s in stamps).values())
    assert max(sizes) <= max(rows, second)
    # full but for the last key that did not fit: no long tail of tiny tasks
    assert len(slices) <= 2 * len(stamps) / rows + 2
    assert count.returned < 42 + 62 * sum(1 for level, *_ in count.asked if level != "hour") * 3
    assert [a for a in count.asked if a[0] == "hour"] == [("hour", None, None)]


def test_slices_from_a_moment_on():
    stamps = _stamps()
    low = (START + timedelta(hours=5)).isoformat(" ")
    slices = planned(Counted(stamps), 100, low)
    assert slices[0].low == low and slices[-1].high is None
    for stamp in stamps[::5]:
        assert sum(_within(s, stamp) for s in slices) == int(stamp >= low)


def test_one_heavy_key_is_counted_finer_and_others_are_not():
    count = Counted(_stamps())
    planned(count, 400)
    minutes = [a for a in count.asked if a[0] == "minute"]
    assert minutes and all(low is not None and high is not None for _, low, high in minutes)
    assert all(high[:13] > low[:13] for _, low, high in minutes)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 500), st.integers(0, 90), max_size=60), st.integers(1, 120))
def test_merged_keys(found, rows):
    counts = [(f"{k:04d}", n) for k, n in found.items()]
    slices = equal_depth(counts, rows)
    assert slices[0].low is None and slices[-1].high is None
    assert [a.high for a in slices[:-1]] == [b.low for b in slices[1:]]
    assert sum(s.rows for s in slices) == sum(found.values())
    assert all(s.rows <= max(rows, *found.values()) for s in slices) if found else len(slices) == 1


def test_empty_table_and_bad_depth():
    assert planned(Counted([]), 10) == [Slice(None, None, 0)]
    assert Slice(None, None, 0).predicate() == "request_ts IS NOT NULL"
    with pytest.raises(ValueError):
        equal_depth([], 0)


def test_predicates_hold_on_stored_text(spark):
    stamps = [*_stamps(400), None]
    rows = spark.createDataFrame([(s,) for s in stamps], "request_ts string")
    predicates = [s.predicate() for s in planned(Counted(stamps[:-1]), 40)] + ["request_ts IS NULL"]
    hits = sum(F.coalesce(F.expr(p), F.lit(False)).cast("int") for p in predicates)
    assert rows.where(hits != 1).count() == 0


def test_counts_in_the_words_of_each_database():
    assert key_expression("mysql", "minute") == "DATE_FORMAT(request_ts, '%Y-%m-%d %H:%i:00')"
    assert key_expression("postgresql", "hour") == "TO_CHAR(DATE_TRUNC('hour', request_ts), 'YYYY-MM-DD HH24:MI:SS')"
    assert key_expression("sqlite", "second") == "SUBSTR(request_ts, 1, 19)"
    assert count_query("sqlite", "log_entries", "hour") == (
        "SELECT SUBSTR(request_ts, 1, 13) AS slot, COUNT(*) AS n FROM log_entries WHERE request_ts IS NOT NULL GROUP BY SUBSTR(request_ts, 1, 13)"
    )
    bounded = count_query("mysql", "t", "minute", "2024-01-01 05:00:00", "2024-01-01 07:00:00")
    assert "WHERE request_ts >= '2024-01-01 05:00:00' AND request_ts < '2024-01-01 07:00:00' GROUP BY" in bounded


class _Reader:
    """Stands in for the session's reader: answers counts, keeps what a read asks for."""

    def __init__(self, stamps, frame):
        self.count, self.frame, self.queries, self.read = Counted(stamps), frame, [], self
        self.settings: dict = {}

    def format(self, name):
        assert name == "jdbc"
        return self

    def options(self, query, **settings):
        self.queries.append(query)
        self.settings = settings
        return self

    def load(self):
        return self

    def collect(self):
        query = self.queries[-1]
        if "MAX(" in query:
            return [(self.count.stamps[-1],)]
        level = next(k for k, n in LEVELS.items() if f"1, {n})" in query)
        bounds = {op: text.split("'")[0] for op, text in (p.split(" '", 1) for p in query.split("request_ts ")[1:] if " '" in p)}
        return self.count(level, bounds.get(">="), bounds.get("<"))

    def jdbc(self, url, table, predicates, properties):
        self.url, self.table, self.predicates, self.properties = url, table, predicates, properties
        return self.frame


def test_reader_plans_slices_and_never_reads_in_one_task_silently(spark, seed_log):
    stamps = _stamps(2_000, "T")
    reader = _Reader(stamps, seed_log)
    read_jdbc(reader, "sqlite", "/data/log.db", rows_per_slice=200)
    assert reader.predicates[-1] == "request_ts IS NULL" and len(reader.predicates) > 10
    assert reader.properties["fetchsize"] == "10000" and "dbtable" not in reader.properties
    assert "dbtable" not in reader.settings  # a query and a table exclude each other
    since = read_since = datetime(2024, 3, 1, 9, 30)
    found = depth_slices(_Reader(stamps, seed_log), "sqlite", "/data/log.db", 200, since)
    assert found[0].startswith("request_ts >= '2024-03-01T09:30:00")  # in the stored form
    rows = spark.createDataFrame([(s,) for s in stamps], "request_ts string")
    hits = sum(F.expr(p).cast("int") for p in found)
    assert rows.where(hits == 1).count() == sum(s >= read_since.isoformat() for s in stamps)
    read_jdbc(reader, "sqlite", "/data/log.db", slices=1, since=since)
    assert reader.predicates == ["request_ts >= '2024-03-01 09:30:00.000000'"]
    with pytest.raises(ValueError, match="start"):
        read_jdbc(reader, "sqlite", "/data/log.db", slices=4)


# --- Questions that a database answers ---------------------------------------


def test_catalog_options():
    found = catalog_options("timescale", "postgresql://ann:pw@db.example/dns", fetchsize="500")
    assert found["url"] == "jdbc:postgresql://db.example/dns" and found["user"] == "ann" and found["fetchsize"] == "500"
    assert {found[k] for k in found if k.startswith("pushDown")} == {"true"} and "dbtable" not in found


def test_open_database_sets_a_catalog(spark):
    with pytest.raises(Exception, match="org.sqlite.JDBC"):
        open_database(spark, "sqlite", "/nowhere/log.db", name="nowhere")
    assert spark.conf.get("spark.sql.catalog.nowhere.pushDownAggregate") == "true"
    for name in ("nowhere", *(f"nowhere.{k}" for k in catalog_options("sqlite", "/nowhere/log.db"))):
        spark.conf.unset(f"spark.sql.catalog.{name}")


def _aggregates(frame):
    """Aggregate nodes of the optimised plan, the lowest last."""
    found, todo = [], [frame._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop(0)
        if node.nodeName() == "Aggregate":
            found.append(node)
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def _in_sql(spark, expression, url):
    """An expression as a database's dialect writes it; None where it cannot."""
    jvm = spark._jvm.org.apache.spark.sql
    built = getattr(jvm.catalyst.util, "V2ExpressionBuilder")(expression, False).build()
    if built.isEmpty():
        return None
    text = jvm.jdbc.JdbcDialects.get(url).compileExpression(built.get())
    return None if text.isEmpty() else text.get()


@pytest.mark.parametrize(("url", "quote"), [("jdbc:mysql://db/x", "`"), ("jdbc:postgresql://db/x", '"')])
def test_databases_can_count_at_the_source(spark, seed_log, url, quote):
    log = seed_log.select("*")
    frames = {
        "domains": ranking.grouped_counts(log, "question_name", at_source=True),
        "types": ranking.query_types_breakdown(log, "30d", AS_OF, at_source=True),
        "stats": snapshot.stats_24h(log, AS_OF, at_source=True),
    }
    for name, frame in frames.items():
        lowest = _aggregates(frame)[-1]
        groups = lowest.groupingExpressions()
        for i in range(groups.size()):  # bare columns
            assert groups.apply(i).nodeName() == "AttributeReference"
            assert _in_sql(spark, groups.apply(i), url) == f"{quote}{groups.apply(i).name()}{quote}"
        outputs = lowest.aggregateExpressions().mkString(" ")
        assert "count(1)" in outputs
        case = f"CASE WHEN {quote}response_type{quote} = 'BLOCKED' THEN 1 ELSE 0 END"
        sums = [s for s in _inside(lowest.aggregateExpressions()) if s.nodeName() == "Sum"]
        if name != "types":
            assert [_in_sql(spark, s.child(), url) for s in sums] == [case]


def _inside(expressions):
    todo = [expressions.apply(i) for i in range(expressions.size())]
    while todo:
        node = todo.pop()
        yield node
        todo += [node.children().apply(i) for i in range(node.children().size())]


@pytest.mark.parametrize("filter", ["all", "blocked"])
def test_counting_at_the_source_gives_the_same(seed_log, filter):
    named = seed_log.withColumn("question_name", F.when(F.col("duration_ms") == 7, "unknown").otherwise(F.col("question_name")))
    here, there = QueryLog(named, AS_OF), QueryLog(named, AS_OF, at_source=True)
    for kind in ("domains", "clients"):
        a, b = (q.top_list(kind, "30d", filter=filter) for q in (here, there))
        assert a.items.collect() == b.items.collect() and a.totals.collect() == b.totals.collect()
    assert here.stats_24h().collect() == there.stats_24h().collect()
    assert here.query_types_breakdown("30d").collect() == there.query_types_breakdown("30d").collect()
    nothing = QueryLog(named.limit(0), AS_OF, at_source=True)
    assert tuple(nothing.stats_24h().first()) == (0, 0)
