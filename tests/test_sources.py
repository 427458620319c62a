"""Readers and writers: line formats, file selection, layouts, options."""

from __future__ import annotations

import os
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import Observation
from pyspark.sql import functions as F
from seed import AS_OF, seed_rows, within

from querylog import read_payloads, read_query_log, write_table, write_tsv
from querylog.functions.predicates import in_range
from querylog.schema import LOG_COLUMNS, LOG_SCHEMA, utc_wall_clock
from querylog.sources.jdbc import jdbc_options, normalise_rows, time_slices
from querylog.sources.jsonl import parse_jsonl_lines, read_jsonl
from querylog.sources.tsv import parse_timestamp, parse_tsv_lines, read_tsv, tsv_rejects


def _line(**changes):
    values = {
        "request_ts": "2024-01-30T10:00:00.000Z",
        "client_ip": "10.0.0.1",
        "client_name": "laptop",
        "duration_ms": "5",
        "reason": "RESOLVED",
        "question_name": "example.org",
        "answer": "192.0.2.1",
        "response_code": "NOERROR",
        "response_type": "RESOLVED",
        "question_type": "A",
        "hostname": "host",
    }
    return "\t".join({**values, **changes}.values())


def _lines(spark, *lines):
    return spark.createDataFrame([(line,) for line in lines], "value string")


def _write(path: Path, *lines: str, age: int = 0):
    path.write_text("\n".join(lines) + "\n")
    stamp = 1_700_000_000 - age
    os.utime(path, (stamp, stamp))


def _domains(log):
    return sorted(r["question_name"] for r in log.collect())


# --- Tab-separated lines -----------------------------------------------------


def test_tsv_fields(spark):
    row = parse_tsv_lines(_lines(spark, _line())).select("*", F.unix_millis("request_ts")).first()
    assert row[-1] == 1706608800000
    assert row["duration_ms"] == 5 and row["hostname"] == "host"
    assert row["id"] is None and row["effective_tldp"] is None


def test_tsv_schema(spark):
    assert parse_tsv_lines(_lines(spark, _line())).columns == LOG_COLUMNS


@pytest.mark.parametrize(
    "text, expected",
    [("12", 12), ("12ms", 12), ("", None), ("ms", None), ("-3", -3), (" 7", 7), ("1.9", 1)],
)
def test_tsv_duration(spark, text, expected):
    row = parse_tsv_lines(_lines(spark, _line(duration_ms=text))).first()
    assert row["duration_ms"] == expected


def test_tsv_malformed(spark):
    short = _line().rsplit("\t", 1)[0]
    lines = _lines(spark, "", " \t ", short, _line() + "\textra", _line() + "\r", _line(hostname=""))
    rows = parse_tsv_lines(lines).collect()
    assert [r["hostname"] for r in rows] == ["host", "host", None]
    assert [tuple(r) for r in tsv_rejects(lines).collect()] == [(short, 10)]


def test_tsv_outer_empty_fields(spark):
    lines = _lines(spark, _line(hostname=""), _line(request_ts=""))
    kept = parse_tsv_lines(lines).collect()
    assert [r["request_ts"] is None for r in kept] == [False, True]
    # Stripping outer tabs costs each of these lines a field.
    assert parse_tsv_lines(lines, strict_trim=True).count() == 0
    assert [r["n_fields"] for r in tsv_rejects(lines, strict_trim=True).collect()] == [10, 10]


@pytest.mark.parametrize("session_zone", ["UTC", "America/New_York"])
@pytest.mark.parametrize(
    "text, zone, expected",
    [
        ("2024-01-30T23:17:00.123Z", "Europe/Berlin", "2024-01-30 23:17:00.123"),
        ("2024-01-30T23:17:00+02:00", "UTC", "2024-01-30 21:17:00.000"),
        ("2024-01-30 23:17:00", "UTC", "2024-01-30 23:17:00.000"),
        ("2024-01-30 23:17:00", "Europe/Berlin", "2024-01-30 22:17:00.000"),
        ("2024-01-30 23:17", "UTC", "2024-01-30 23:17:00.000"),
        ("2024-01-30", "UTC", "2024-01-30 00:00:00.000"),
        ("10:00", "UTC", None),
        ("yesterday", "UTC", None),
    ],
)
def test_timestamps(spark, session_zone, text, zone, expected):
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        wall = utc_wall_clock(parse_timestamp(F.lit(text), zone))
        found = spark.range(1).select(F.date_format(wall, "yyyy-MM-dd HH:mm:ss.SSS")).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert found == expected


# --- File selection ----------------------------------------------------------


def test_directory_without_logs(spark, tmp_path):
    _write(tmp_path / "resolver.conf", _line())
    for kind in ("csv", "csv-client"):
        for latest in (False, True):
            log = read_query_log(spark, kind, str(tmp_path), latest_only=latest)
            assert log.schema == LOG_SCHEMA and log.count() == 0


def test_newest_file(spark, tmp_path):
    for age, name in ((300, "march.log"), (100, "april.log"), (500, "may.log")):
        _write(tmp_path / name, _line(question_name=name), age=age)
    assert _domains(read_tsv(spark, str(tmp_path), latest_only=True)) == ["april.log"]
    assert len(_domains(read_tsv(spark, str(tmp_path)))) == 3
    _write(tmp_path / "june.log", _line(question_name="june.log"), age=100)  # a tie: one of the two
    latest = _domains(read_tsv(spark, str(tmp_path), latest_only=True))
    assert latest in (["april.log"], ["june.log"])


def test_latest_date(spark, tmp_path):
    _write(tmp_path / "2024-01-29_laptop.log", _line(question_name="old"))
    _write(tmp_path / "2024-01-30_laptop.log", _line(question_name="a"), age=100)
    _write(tmp_path / "2024-01-30_phone.log", _line(question_name="b"), age=200)
    _write(tmp_path / "other.log", _line(question_name="other"))
    latest = read_tsv(spark, str(tmp_path), per_client=True, latest_only=True)
    assert _domains(latest) == ["a", "b"]
    assert _domains(read_tsv(spark, str(tmp_path), per_client=True)) == ["a", "b", "old"]


def test_missing_directory(spark, tmp_path):
    for latest in (False, True):
        with pytest.raises(AnalysisException):
            read_tsv(spark, str(tmp_path / "none"), latest_only=latest)


def test_source_kinds(spark):
    with pytest.raises(ValueError, match="kind"):
        read_query_log(spark, "excel", "x")
    for kind in ("csv", "mysql", "sqlite", "console"):
        with pytest.raises(ValueError, match="target"):
            read_query_log(spark, kind, None)


# --- JSON lines --------------------------------------------------------------


def _record(**changes):
    import json

    values = {"_time": "2024-01-30T10:00:00Z", "prefix": "queryLog", "question_name": "a.example"}
    return json.dumps({**values, **changes})


def test_json_records(spark):
    lines = _lines(
        spark,
        _record(duration_ms="12", client_names="a; b", response_reason="CACHED", extra="x"),
        _record(duration_ms="12.7", client_names=""),
        _record(duration_ms="soon", question_name=""),
        _record(prefix="server"),
        " ",
    )
    rows = parse_jsonl_lines(lines).collect()
    assert [r["duration_ms"] for r in rows] == [12, 12, None]
    assert [r["client_name"] for r in rows] == ["a; b", None, None]
    assert [r["question_name"] for r in rows] == ["a.example", "a.example", None]
    assert rows[0]["reason"] == "CACHED" and rows[0]["hostname"] is None


def test_json_malformed(spark, tmp_path):
    (tmp_path / "a.json").write_text(_record() + "\n{broken\n" + _record() + "\n")
    assert read_jsonl(spark, str(tmp_path), malformed="drop").count() == 2
    lines = _lines(spark, _record(), "{broken")
    assert parse_jsonl_lines(lines, malformed="drop").count() == 1
    for log in (read_jsonl(spark, str(tmp_path)), parse_jsonl_lines(lines)):
        with pytest.raises(Exception, match="(?i)malformed"):
            log.collect()


# --- Databases: options only, as no database runs in the tests ---------------


def test_jdbc_urls():
    mysql = jdbc_options("mysql", "mysql://ann:p%40ss@db.example:3307/dns?useSSL=true")
    assert mysql["url"] == "jdbc:mysql://db.example:3307/dns?useSSL=true"
    assert (mysql["user"], mysql["password"]) == ("ann", "p@ss")
    assert mysql["connectionTimeZone"] == "UTC" and mysql["dbtable"] == "log_entries"
    for kind in ("postgresql", "timescale"):
        for scheme in ("postgresql", "postgres"):
            found = jdbc_options(kind, f"{scheme}://db.example/dns")
            assert found["url"] == "jdbc:postgresql://db.example/dns"
            assert "UTC" in found["sessionInitStatement"] and "user" not in found
    sqlite = jdbc_options("sqlite", "/data/log.db")
    assert sqlite["url"] == "jdbc:sqlite:/data/log.db" and sqlite["open_mode"] == "1"
    with pytest.raises(ValueError, match="URI"):
        jdbc_options("mysql", "postgresql://db.example/dns")


def _moment(day):
    return datetime(2024, 1, day, tzinfo=timezone.utc)


@pytest.mark.parametrize("since", [None, 0, 5, 40])
def test_time_slices_cover_once(spark, since):
    from datetime import timedelta

    start = None if since is None else _moment(10) + timedelta(days=since - 5)
    slices = time_slices(_moment(10), _moment(20), 4, start)
    stamps = [_moment(1) + timedelta(hours=7 * i) for i in range(140)] + [_moment(10), None]
    rows = spark.createDataFrame([(s,) for s in stamps], "request_ts timestamp")
    hits = sum(F.coalesce(F.expr(s), F.lit(False)).cast("int") for s in slices)
    counted = {r["request_ts"]: r["n"] for r in rows.select("*", hits.alias("n")).collect()}
    for stamp in stamps:
        known = stamp and stamp.replace(tzinfo=None)
        expected = 1 if start is None else int(stamp is not None and stamp >= start)
        assert counted[known] == expected


def test_database_rows(spark):
    rows = spark.createDataFrame(
        [("2024-01-30 10:00:00.000", "a", 3, "")],
        "request_ts string, Client_Name string, duration_ms int, question_name string",
    )
    log = normalise_rows(rows)
    assert log.schema == LOG_SCHEMA
    row = log.first()
    assert row["request_ts"] == datetime(2024, 1, 30, 10)
    assert (row["client_name"], row["duration_ms"], row["question_name"]) == ("a", 3, "")
    assert normalise_rows(rows, empty_as_null=True).first()["question_name"] is None


# --- Writers -----------------------------------------------------------------


def test_tsv_round_trip(spark, seed_log, tmp_path):
    write_tsv(seed_log, f"{tmp_path}/all")
    write_tsv(seed_log, f"{tmp_path}/split", per_client=True)
    expected = sorted(map(str, seed_log.collect()))
    for name in ("all", "split"):
        back = read_tsv(spark, f"{tmp_path}/{name}")
        assert sorted(map(str, back.collect())) == expected
    keys = {p.name for p in Path(tmp_path, "split").glob("*/*")}
    assert keys == {
        "client_key=tablet",
        "client_key=Desk-2",
        "client_key=tv",
        "client_key=__HIVE_DEFAULT_PARTITION__",
    }
    last = seed_log.agg(F.max(F.to_date("request_ts"))).first()[0]
    newest = seed_log.where(F.to_date("request_ts") == F.lit(last)).count()
    for kind, name in (("csv", "all"), ("csv-client", "split")):
        assert read_query_log(spark, kind, f"{tmp_path}/{name}").count() == len(expected)
        latest = read_query_log(spark, kind, f"{tmp_path}/{name}", latest_only=True)
        assert latest.count() == newest
    files = list(Path(tmp_path, "split").glob("*/*/*.txt"))
    for file in files:
        lines = file.read_text().splitlines()
        assert lines == sorted(lines)


def test_tsv_values_stay_on_their_line(spark, seed_log, tmp_path):
    dirty = seed_log.limit(1).withColumn("answer", F.lit("a\tb\nc"))
    write_tsv(dirty, f"{tmp_path}/t")
    assert read_tsv(spark, f"{tmp_path}/t").first()["answer"] == "a b c"


def test_client_with_most_rows_is_split(spark, tmp_path):
    """A client holding nine tenths of a day is written by several tasks."""
    n = 200_000
    hot = F.when(F.col("id") % 10 == 0, F.concat(F.lit("c"), F.col("id") % 7)).otherwise("hot")
    log = spark.range(0, n, 1, 8).select(
        *(
            {
                "id": F.col("id"),
                "request_ts": F.lit(AS_OF),
                "client_name": hot,
                "answer": F.sha2(F.col("id").cast("string"), 256),
            }
            .get(f.name, F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in LOG_SCHEMA
        )
    )
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "256KB")
    try:
        write_tsv(log, f"{tmp_path}/t", per_client=True)
    finally:
        spark.conf.unset(key)
    assert len(list(Path(tmp_path).glob("t/*/client_key=hot/*.txt"))) > 2
    assert read_tsv(spark, f"{tmp_path}/t").count() == n


@pytest.mark.parametrize("rebalance", [True, False])
def test_table_prunes_dates(spark, seed_log, tmp_path, rebalance):
    undated = seed_log.limit(1).withColumn("request_ts", F.lit(None).cast("timestamp"))
    write_table(seed_log.unionByName(undated), f"{tmp_path}/t", rebalance=rebalance)
    log = read_query_log(spark, "table", f"{tmp_path}/t")
    assert log.count() == len(seed_rows()) + 1
    recent = log.where(in_range(log, "24h", AS_OF))
    assert recent.count() == len(within("24h"))
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(request_date" in plan
    assert "GreaterThanOrEqual(request_ts" in plan
    files = recent.select(F.input_file_name()).distinct().collect()
    assert all("2024-06-1" in f[0] for f in files)


# --- Payloads ----------------------------------------------------------------


def test_payload_files(spark, tmp_path):
    from test_snapshot import payload

    (tmp_path / "a.json").write_text(payload(indent=2))
    (tmp_path / "b.json").write_text("{}")
    found = read_payloads(spark, str(tmp_path), whole_files=True).collect()
    assert sorted(r["payload"] is None for r in found) == [False, True]


def test_seed_rows_are_complete():
    assert len(seed_rows()) == 55


@pytest.mark.parametrize("options", [{}, {"since": AS_OF}, {"start": AS_OF, "end": AS_OF}])
def test_missing_driver_is_reported(spark, options):
    """Without the driver JAR the reader fails before it connects anywhere."""
    with pytest.raises(Exception, match="org.sqlite.JDBC"):
        read_query_log(spark, "sqlite", "/nowhere/log.db", **options)


@pytest.mark.parametrize("per_client", [False, True])
def test_log_files_beside_written_dates_are_read_as_well(spark, seed_log, tmp_path, per_client):
    write_tsv(seed_log, f"{tmp_path}/t", per_client=per_client)
    beside = tmp_path / "t" / "2024-01-30_laptop.log"
    beside.write_text("\t".join(["2024-01-30 10:00:00", "1.1.1.1", "c", "1", "r", "q", "a", "NOERROR", "CACHED", "A", "h"]) + "\n")
    assert read_tsv(spark, f"{tmp_path}/t", per_client=per_client).count() == len(seed_rows()) + 1
    assert read_tsv(spark, f"{tmp_path}/t", glob="*.log").count() == 1
    with pytest.raises(ValueError, match="beside written dates"):
        read_tsv(spark, f"{tmp_path}/t", per_client=per_client, latest_only=True)


def test_rejects_are_counted_in_the_same_pass(spark, tmp_path):
    good = "\t".join("abcdefghijk")
    (tmp_path / "a.log").write_text("\n".join([good, "a\tb", "", " \t ", "x", good + "\textra", "\t".join("abcdefghij"), "y"]) + "\n")
    seen = Observation("lines")
    rows = read_tsv(spark, str(tmp_path), observation=seen)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1
    assert len(rows.collect()) == 2
    assert {k: v for k, v in seen.get.items() if v} == {"lines": 6, "rejects": 4, "fields_1": 2, "fields_2": 1, "fields_10": 1}
    lines = spark.read.text(str(tmp_path))
    assert tsv_rejects(lines).count() == seen.get["rejects"]
