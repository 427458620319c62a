"""Pages of ordered frames that stay distributed at any offset.

A page is located before it is read, as the k-th element of a set is selected: some rows
split the frame, rows are counted between them, and the frame is narrowed to where the
page lies, until so few rows precede it that a plain top-k does. Rows equal to a splitter
are a class of their own, so ties of any number are told apart from what is around them.
No rows are sorted or numbered for it, and nothing is written anywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A page is read once no more than this many rows precede it in what is left.
#: It says how far to narrow; results and needs are the same at any offset.
TOP_K_ROWS = 1_000
#: Rows that split a frame at once: what is left shrinks by about this factor a round.
SPLITTERS = 63


@dataclass(frozen=True)
class Page:
    """A page of rows and the one-row frame of totals over all pages."""

    items: DataFrame
    totals: DataFrame


def top_page(frame: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    return frame.orderBy(*order).offset(offset).limit(limit)


def _literal(values: Row, types: StructType) -> Column:
    """A key as literals of the types that the frame's keys have."""
    return F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(values, types)))


def _splitters(frame: DataFrame, key: Column) -> tuple[list[Row], StructType]:
    """Keys of some rows at random, distinct and in order. Any will do: they only say
    where the frame is split."""
    keys = frame.select(key.alias("key"))
    some = keys.orderBy(F.rand(5)).limit(SPLITTERS)
    return [r["key"] for r in some.distinct().orderBy("key").collect()], keys.schema["key"].dataType


def _class_of(key: Column, splitters: list[Column], low: int, high: int) -> Column:
    """The class of a key: ``2 i + 1`` if it equals splitter ``i``, else the even number
    between those of its neighbours. Found by halves, in a few comparisons."""
    if low == high:
        return F.lit(2 * low)
    middle = (low + high) // 2
    at = splitters[middle]
    return (
        F.when(key < at, _class_of(key, splitters, low, middle))
        .when(key > at, _class_of(key, splitters, middle + 1, high))
        .otherwise(F.lit(2 * middle + 1))
    )


def _bounded(key: Column, splitters: list[Column], first: int, last: int) -> Column:
    """Whether a key lies in one of the classes ``first`` to ``last``."""
    bound = F.lit(True)
    if first > 0:
        bound = key >= splitters[first // 2] if first % 2 else key > splitters[first // 2 - 1]
    if last < 2 * len(splitters):
        bound = bound & (key <= splitters[last // 2] if last % 2 else key < splitters[last // 2])
    return bound


def page_of(frame: DataFrame, keys: list[Column], order: list[Column], limit: int, offset: int) -> DataFrame:
    """The page of a frame in ``order``, which sorts by ``keys`` ascending, nulls first.

    What precedes the page by more than :data:`TOP_K_ROWS` rows is left out by rounds of
    two jobs, that run in this call. Rows equal in all keys are taken for copies.
    """
    key = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)))
    skip = offset
    while skip > TOP_K_ROWS:
        found, types = _splitters(frame, key)
        at = [_literal(values, types) for values in found]
        sizes = frame.groupBy(_class_of(key, at, 0, len(at)).alias("place")).agg(F.count("*").alias("n"))
        first = last = None
        before = start = size = 0
        for place, n in sorted((r["place"], r["n"]) for r in sizes.collect()):
            if before < skip + limit and before + n > skip:
                if first is None:
                    first, start, size = place, before, n
                last = place
            before += n
        if first is None:
            return frame.where(F.lit(False))
        if first % 2 and skip - start > TOP_K_ROWS:
            # Rows equal to the page's first precede it: any of them will do.
            head = frame.where(_bounded(key, at, first, first)).limit(min(limit, start + size - skip))
            if last == first:
                return head
            rest = frame.where(_bounded(key, at, first + 1, last))
            return head.unionByName(rest).orderBy(*order).limit(limit)
        frame, skip = frame.where(_bounded(key, at, first, last)), skip - start
    return top_page(frame, order, limit, skip)
