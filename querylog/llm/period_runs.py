"""Periodic runs of words, from maximal pairs in each text.

A run is a stretch of words that repeats with a period of at most half its length and
that no neighbouring word carries on. The suffixes of a text are ranked by prefix
doubling; the lengths that neighbours in this order share make up a tree of
LCP-intervals, which is walked from the bottom up. Each interval keeps the list of its
positions, in text order, with the word to the left of each as its class. When two
children meet in an interval of common length ``l``, positions of different children and
of different left words are maximal pairs: they share ``l`` words and no word more on
either side. If their distance ``p`` is at most ``l``, then ``p + l`` words repeat with
the period ``p``, and the mismatches on both sides say that no neighbour carries this on:
the pair is a run, and nothing has to be extended.

Only neighbours in text order have to be compared. The smallest period of a run is a
primitive stretch of words, which occurs in two copies of itself at their starts alone;
so between the two positions of a run's pair there is no third one. Pairs with a
multiple of the period name the same stretch, of which the smallest period is kept. So
a text of ``n`` words takes about ``n log n`` steps however often its words repeat.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from querylog.llm.shared import let

#: Words in a run at least.
LEAST_LENGTH = 12

_ADDED = "n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def doubled_ranks(ids: np.ndarray) -> list[np.ndarray]:
    """Ranks of the stretches of 1, 2, 4, … words from each position, until all differ.

    A stretch that the end of the text cuts off ranks before those that go on.
    """
    n = len(ids)
    ranks = [np.unique(ids, return_inverse=True)[1].astype(np.int64)]
    width = 1
    while int(ranks[-1].max()) < n - 1:
        key = ranks[-1] * np.int64(n + 1)
        key[: n - width] += ranks[-1][width:] + 1
        ranks.append(np.unique(key, return_inverse=True)[1].astype(np.int64))
        width *= 2
    return ranks


def shared_lengths(ranks: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Words that each suffix in ``order`` shares with the next one."""
    n = len(order)
    a, b = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(n - 1, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        left, right = np.append(ranks[k], -1), np.append(ranks[k], -2)
        step = np.where(left[np.minimum(a, n)] == right[np.minimum(b, n)], 1 << k, 0)
        a, b, shared = a + step, b + step, shared + step
    return shared


def _repeats(ids: np.ndarray, size: int) -> bool:
    """Whether some stretch of ``size`` words may occur twice; no false negatives."""
    count = len(ids) - size + 1
    if count < 2:
        return False
    key = np.zeros(count, np.uint64)
    for i in range(size):
        key = key * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + count].astype(np.uint64) + np.uint64(1)
    key.sort()
    return bool((key[1:] == key[:-1]).any())


def _met(into: list[int], few: list[int], depth: int, lefts: list[int], found: dict[tuple[int, int], int], least: int) -> None:
    """Pairs of a position in ``few`` and its neighbours in ``into``; then one list of both."""
    for x in few:
        at = bisect_left(into, x)
        for y in into[max(0, at - 1) : at + 1]:
            period = abs(x - y)
            if period <= depth and period + depth >= least and lefts[x] != lefts[y]:
                key = (min(x, y), period + depth)
                found[key] = min(period, found.get(key, period))
    if len(few) * 8 < len(into):
        for x in few:
            into.insert(bisect_left(into, x), x)
    else:
        into += few
        into.sort()


def period_runs(ids: np.ndarray, least: int = LEAST_LENGTH) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of at least ``least`` words, in order."""
    shortest = (least + 1) // 2  # the two positions of a run share half of it at least
    if len(ids) < max(2, least) or not _repeats(ids, shortest):
        return []
    ranks = doubled_ranks(ids)
    order = np.empty(len(ids), np.int64)
    order[ranks[-1]] = np.arange(len(ids))
    shared = shared_lengths(ranks, order)
    lefts = [-1, *ids[:-1].tolist()]
    found: dict[tuple[int, int], int] = {}

    def joined(a: list[int], b: list[int], depth: int) -> list[int]:
        a, b = (a, b) if len(a) >= len(b) else (b, a)
        _met(a, b, depth, lefts, found, least)
        return a

    long = np.append(shared >= shortest, False)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], long.astype(np.int8)))))
    for low, high in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        above: list[tuple[int, list[int]]] = []  # open intervals: common length, positions so far
        last = [int(order[low])]
        for position, depth in zip(order[low + 1 : high + 1].tolist(), shared[low:high].tolist(), strict=True):
            while above and above[-1][0] >= depth:
                deeper, positions = above.pop()
                last = joined(positions, last, deeper)
            above.append((depth, last))
            last = [position]
        while above:
            depth, positions = above.pop()
            last = joined(positions, last, depth)
    return sorted((start, length, period) for (start, length), period in found.items())


def without_repeats(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay when each run keeps its first period alone."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def _found(column: str, kept: list[str], least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, all_runs, collapsed = [], [], []
            for value in batch.column(column).cast(pa.binary()):
                words = (value.as_py() or b"").split()
                known: dict[bytes, int] = {}
                ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
                runs = period_runs(ids, least)
                if runs:
                    stays = without_repeats(len(words), runs).tolist()
                    words = [w for w, stay in zip(words, stays, strict=True) if stay]
                sizes.append(len(ids))
                all_runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                collapsed.append(b" ".join(words))
            added = [pa.array(sizes, pa.int64()), pa.array(all_runs, pa.list_(_RUN)), pa.array(collapsed, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in kept), *added], names=[*kept, "n_words", "runs", "collapsed"]
            )

    return run


def with_runs(docs: DataFrame, column: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """Documents with the periodic runs of a text column.

    Words are what stands between ASCII white space. Adds ``n_words``, ``runs`` (start,
    length and smallest period in words, by start and period) and ``collapsed`` (the
    words that stay when each run keeps its first period alone, joined by one space).
    All other columns stay; those of the same names are replaced. A null or empty text
    has no words, no runs and an empty ``collapsed``. Rows do not depend on each other:
    repeated rows share their results, and there is no shuffle. ``least`` is 2 or more.
    """
    if least < 2:
        raise ValueError("a run has two words at least")
    kept = docs.drop("n_words", "runs", "collapsed")
    whole = kept if column in kept.columns else kept.withColumn(column, docs[column])
    schema = StructType([*kept.schema.fields, *StructType.fromDDL(_ADDED).fields])
    return whole.mapInArrow(_found(column, kept.columns, least), schema)


def longest_run(runs: Column) -> Column:
    """The run with the greatest length, then the smallest start and period; null if none."""
    order = F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"), r.alias("r")))
    return F.array_min(order)["r"]


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """Make the tail of every tenth text (by ``doc_id``) repeat, for trying the operator.

    With ``h`` the CRC of the id, ``g = h div 10`` and ``n`` words: where 10 divides ``h``,
    word ``i >= a = g mod n`` becomes word ``a + (i - a) mod p`` of the text as it was,
    where ``p = 1 + (n - a) div (3 + g mod 8)``. Words are then joined by one space.
    """
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(crc / 10)

    def tail(words: Column) -> Column:
        n = F.size(words).cast("long")

        def moved(a: Column) -> Column:
            p = F.floor((n - a) / (g % 8 + 3)) + 1
            return let(F.struct(a.alias("a"), p.alias("p"), words.alias("w")), lambda s: F.array_join(
                F.transform(s["w"], lambda w, i: F.when(i < s["a"], w).otherwise(F.get(s["w"], (s["a"] + (i - s["a"]) % s["p"]).cast("int")))), " "
            ))

        return F.when(n > 0, moved(g % n)).otherwise("")

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return docs.withColumn("text", F.when(F.col("text").isNotNull() & (crc % 10 == 0), let(words, tail)).otherwise(F.col("text")))
