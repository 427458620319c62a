"""Comparing the members of buckets block by block inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dealt_in_blocks(entries: DataFrame, size: int) -> DataFrame:
    """Deal the members of every bucket into groups that meet all pairs to compare.

    A bucket of at most ``size`` members is one group. In a larger one the members of
    the component that has most of them need not meet each other: they and the others
    are cut by hash into blocks of about ``size``, the others go to every pair of blocks
    that their own is in, and the members of the large component only to those with a
    block of others. Groups stay bounded however large a bucket is, and what settled
    members cost does not grow by the square of their number. Adds ``block``, ``bi`` and
    ``bj``; :func:`regrouped` lays the rows of a group next to each other.
    """
    by_label = entries.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    counts = by_label.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most"))
    blocks = lambda n: F.ceil(n / size).cast("int")
    fits = F.col("n") <= size
    counts = counts.select(
        "bucket", F.col("most.label").alias("settled"),
        F.when(fits, 0).otherwise(blocks(F.col("most.n"))).alias("first"),
        F.when(fits, 1).otherwise(F.greatest(F.lit(1), blocks(F.col("n") - F.col("most.n")))).alias("open"),
    )
    settled = (F.col("label") == F.col("settled")) & (F.col("first") > 0)
    dealt = F.xxhash64("class", F.lit(5))
    block = F.when(settled, F.pmod(dealt, F.greatest("first", F.lit(1)))).otherwise(F.col("first") + F.pmod(dealt, "open")).cast("int")
    lowest = F.when(settled, F.col("first")).otherwise(0)
    return (
        entries.join(counts, "bucket").withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(lowest, F.col("first") + F.col("open") - 1)))
        .withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
        .drop("first", "open", "settled", "other")
    )


def regrouped(frame: DataFrame) -> DataFrame:
    return frame.repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj", "class")


def by_group(batches: Iterator[pa.RecordBatch], body: Callable[[pa.Table], pa.RecordBatch | None]):
    """Apply a function to each run of rows with equal bucket and blocks."""
    rest: pa.Table | None = None
    for batch in batches:
        whole = pa.Table.from_batches([batch])
        whole = pa.concat_tables([rest, whole]) if rest is not None else whole
        keys = np.stack([whole.column(k).to_numpy().astype(np.int64) for k in ("bucket", "bi", "bj")])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        starts = [0, *cuts.tolist()]
        for start, end in zip(starts, cuts.tolist(), strict=False):
            if (out := body(whole.slice(start, end - start))) is not None:
                yield out
        rest = whole.slice(starts[-1])
    if rest is not None and rest.num_rows and (out := body(rest)) is not None:
        yield out


def compared(group: pa.Table) -> np.ndarray:
    """The pairs that a group is there to compare: across its blocks and components."""
    labels = np.unique(np.array(group.column("label").to_pylist(), dtype=object), return_inverse=True)[1]
    pairs = np.triu(labels[:, None] != labels[None, :], 1)
    bi, bj = group.column("bi")[0].as_py(), group.column("bj")[0].as_py()
    if bi != bj:
        block = group.column("block").to_numpy()
        pairs &= block[:, None] != block[None, :]
    return pairs


def first_met(bands: np.ndarray, bucket: int, pairs: np.ndarray) -> np.ndarray:
    """Leave only pairs that share no earlier band than this bucket's."""
    band = int(np.flatnonzero(bands[0] == bucket)[0])
    for i in range(band):
        if not pairs.any():
            break
        pairs = pairs & (bands[:, None, i] != bands[None, :, i])
    return pairs


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices a strip at a time."""
    n, strip = len(sets), 8192
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = count > 1
    index = (np.cumsum(common) - 1)[place]
    kept = common[place]
    owner, index = owner[kept], index[kept]
    order = np.argsort(index, kind="stable")
    owner, index = owner[order], index[order]
    out = np.zeros((n, n), np.float64)
    for low in range(0, int(common.sum()), strip):
        a, b = np.searchsorted(index, (low, low + strip))
        ones = np.zeros((n, min(strip, int(common.sum()) - low)), np.float32)
        ones[owner[a:b], index[a:b] - low] = 1
        out += ones @ ones.T
    return out.astype(np.int64)


def spanning(pairs: np.ndarray) -> list[tuple[int, int]]:
    """Enough of the linked pairs to connect what they connect."""
    root = list(range(len(pairs)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(*(x.tolist() for x in np.nonzero(pairs)), strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out
