"""Periodic runs against plain enumeration."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from querylog.llm.period_runs import longest_run, period_runs, with_planted_periods, with_runs, without_repeats
from querylog.llm.registered import op11_periodic_runs

SF_DIR = "/root/testdata/sf0.001"


def plain_runs(words, least=12):
    """Every stretch of every period that cannot be carried on, by its smallest period."""
    n, best = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            length = i - start + p
            if i > start and length >= max(least, 2 * p):
                best[start, length] = min(p, best.get((start, length), p))
            i += i == start
    return sorted((s, n, p) for (s, n), p in best.items())


def plain_answer(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    top = min(((-length, s, p) for s, length, p in runs), default=None)
    return (
        len(runs), *((top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4),
        hashlib.sha256("".join(f"{s},{length},{p}\n" for s, length, p in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    )


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 12), st.integers(2, 8), st.sampled_from([2, 4, 7, 12]))
def test_equals_enumeration(words, period, times, least):
    words = words + (words[-period:] or [1]) * times + words[:3]
    assert period_runs(np.array(words, np.int64), least) == plain_runs(words, least)


@pytest.mark.parametrize(
    "words",
    [[0] * 30_000, [0, 1] * 15_000, [i % 7 for i in range(30_000)], ([*range(50)] + [99]) * 600, [i % 2 if i < 9_000 else i for i in range(30_000)]],
)
def test_long_and_very_periodic_texts(words):
    runs = period_runs(np.array(words, np.int64))
    assert len(runs) == 1 and runs[0][0] == 0
    start, length, period = runs[0]
    assert all(words[i] == words[i + period] for i in range(start, start + length - period))
    assert without_repeats(len(words), runs).sum() == len(words) - length + period


def test_a_phrase_that_recurs_far_apart_is_no_run():
    words = [w for i in range(2_000) for w in (1, 2, 3, 4, 5, 6, 7, 8, 100 + i, 5_000 + i, 9_000 + i)]
    assert period_runs(np.array(words, np.int64)) == []


def test_query_equals_enumeration(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.filter("length(coalesce(text, '')) < 9000").collect()}
    rows = {r["doc_id"]: tuple(r)[1:] for r in op11_periodic_runs(spark, SF_DIR).collect()}
    assert len(rows) == docs.count()
    assert {i: rows[i] for i in texts} == {i: plain_answer(i, t) for i, t in texts.items()}
    assert sum(rows[i][0] > 0 for i in texts) >= 10


def test_edges(spark):
    again = "a b c d " * 5
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, again), (4, again), (None, again), (5, "x " * 20_000), (6, "w\x1cw w\x1cw " * 6), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clashing = docs.withColumns({name: F.lit(name) for name in ("runs", "collapsed", "n_words", "start", "length", "r")})
    found = with_runs(clashing).withColumn("longest", longest_run(F.col("runs"))).collect()
    assert [(r["n_words"], len(r["runs"]), r["collapsed"]) for r in found] == [
        (0, 0, ""), (0, 0, ""), (0, 0, ""), (20, 1, "a b c d"), (20, 1, "a b c d"), (20, 1, "a b c d"),
        (20_000, 1, "x"), (12, 1, "w\x1cw"), (0, 0, ""),
    ]
    assert tuple(found[3]["longest"]) == (0, 20, 4) and found[0]["longest"] is None
    assert {r["start"] for r in found} == {"start"}  # other columns stay
    assert with_runs(docs.limit(0)).collect() == []
    assert with_planted_periods(docs).filter("doc_id IS NULL").select("text").collect()[0]["text"] == again
    with pytest.raises(ValueError):
        with_runs(docs, least=1)


def test_longest_run_breaks_ties_by_start(spark):
    docs = spark.createDataFrame([(1, "a b c " * 4 + "x " + "d e f " * 4)], "doc_id long, text string")
    row = with_runs(docs).select(longest_run(F.col("runs")).alias("r"), F.size("runs").alias("n")).first()
    assert (row["n"], tuple(row["r"])) == (2, (0, 12, 3))
