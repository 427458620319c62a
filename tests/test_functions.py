"""Row functions on hand-picked values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from querylog.functions import answers, display


def _value(spark, column):
    return spark.range(1).select(column).first()[0]


def _text(value):
    return F.lit(value).cast("string")


@pytest.mark.parametrize(
    "answer, expected",
    [
        ("A (203.0.113.4), AAAA (2001:db8::7), A (203.0.113.5)", ["203.0.113.4", "2001:db8::7", "203.0.113.5"]),
        ("", []),
        (None, None),
        ("198.51.100.7", ["198.51.100.7"]),
        ("a, b", ["a, b"]),
        ("MX (10 mail.example.com.)", ["10 mail.example.com."]),
        ("TXT (v=1, x (y)),  AAAA (::1)", ["v=1, x (y)", "::1"]),
        ("A ()", [""]),
        ("a (x)", ["a (x)"]),
    ],
)
def test_answers(spark, answer, expected):
    assert _value(spark, answers.parse_answers(_text(answer))) == expected


# A reason names its list if all of these hold: it begins with the word, has one bracket
# after it that runs to its end, and a colon and a space after some text in the bracket.
_OPENERS = {"BLOCKED (": True, "bLoCkEd (": True, "BLOCKED by rule (": True, "BLOCKED(": False, "NOT BLOCKED (": False, "BLOCKED [": False}
_INNER = {"tv-adverts: host.test": "tv-adverts", "two words: a: b": "two words", "x:y: z": "x:y", "no separator": None, "glued:host": None, "": None, ": host": None}
_ENDS = {")": True, ") \t": True, ")\n": True, "": False, ") and more": False, ")]": False}


def _reasons():
    for opener, opens in _OPENERS.items():
        for inner, group in _INNER.items():
            for end, ends in _ENDS.items():
                yield f" {opener}{inner}{end}", group if opens and ends else None


def test_blocking_group(spark):
    cases = [*_reasons(), (None, None), ("", None), ("BLOCKED", None)]
    frame = spark.createDataFrame([(reason,) for reason, _ in cases], "reason string")
    found = frame.select(answers.blocking_group(F.col("reason")).alias("group")).collect()
    assert [r["group"] for r in found] == [group for _, group in cases]


@pytest.mark.parametrize(
    "response_type, reason, expected",
    [
        ("BLOCKED", "BLOCKED (ads: x)", "ads"),
        ("blocked", "BLOCKED", None),
        ("RESOLVED", "CONDITIONAL", "CONDITIONAL"),
        ("RESOLVED", "resolved", None),
        ("RESOLVED", None, None),
        (None, "CACHED", "CACHED"),
    ],
)
def test_detail(spark, response_type, reason, expected):
    assert _value(spark, answers.result_detail(_text(response_type), _text(reason))) == expected


@pytest.mark.parametrize(
    "reason, response_type, text, note",
    [
        ("RESOLVED (dns.example)", "RESOLVED", "RESOLVED", "Resolved by: dns.example"),
        ("BLOCKED (ads)", "BLOCKED", "BLOCKED", "Group: ads"),
        ("CACHED", "CACHED", "CACHED", None),
        ("A (b) c (d)", "CUSTOMDNS", "A  c (d)", "b"),
        ("A ()", "CUSTOMDNS", "A", None),
        ("RESOLVED", "RESOLVED", "RESOLVED", None),
        ("", "RESOLVED", None, None),
        (None, "RESOLVED", None, None),
        ("A (b)", None, "A", "b"),
    ],
)
def test_reason(spark, reason, response_type, text, note):
    assert _value(spark, display.reason_text(_text(reason))) == text
    assert _value(spark, display.reason_note(_text(reason), _text(response_type))) == note


@pytest.mark.parametrize(
    "duration, response_type, expected",
    [
        (0, "CACHED", "—"),
        (0, "RESOLVED", "0ms"),
        (0, "CONDITIONAL", "0ms"),
        (0, None, "0ms"),
        (12, "BLOCKED", "12ms"),
        (None, "CACHED", None),
    ],
)
def test_duration(spark, duration, response_type, expected):
    label = display.duration_label(F.lit(duration).cast("long"), _text(response_type))
    assert _value(spark, label) == expected


@pytest.mark.parametrize(
    "count, compact, short",
    [
        (0, "0", "0"),
        (999, "999", "999"),
        (1000, "1.0K", "1.0K"),
        (1250, "1.3K", "1.3K"),
        (12_345, "12.3K", "12.3K"),
        (999_999, "1,000.0K", "1000.0K"),
        (1_000_000, "1.0M", "1000.0K"),
        (1_234_567_890, "1,234.6M", "1234567.9K"),
    ],
)
def test_counts(spark, count, compact, short):
    value = F.lit(count).cast("long")
    assert _value(spark, display.compact_count(value)) == compact
    assert _value(spark, display.short_count(value)) == short


def test_percentage_of_nothing(spark):
    assert _value(spark, display.percentage(F.lit(0), F.lit(0))) == 0.0
