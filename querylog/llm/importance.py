"""Importance resampling of raw text towards a trusted target.

Texts are runs of letters and digits, or of other marks. Their single tokens and
pairs are hashed into ``buckets``; the target and the raw corpus are multinomials
over the buckets, the target's smoothed towards the raw one. A document's weight is
the ratio of the two models, the sum of its tokens' log ratios. Documents are drawn
without replacement in proportion to their weights: Gumbel noise, made from doc_id
and text, is added to the log weight and the ``k`` largest sums stay. ``k`` is the number
of documents whose own log weight reaches ``least``.

Raw counts cover every document. The target is fitted on a bounded number of labelled
rows at most, chosen by hash (see ``trusted_rows``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylog.llm.shared import drop_staged, staged, trusted_rows
from querylog.llm.textkit import mixed, word_hashes

_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\x00-\x200-9A-Za-z\x7f-\xff]+")
BUCKETS = 1 << 16
LEAST = -8.0
SEED = 17


def token_buckets(text: bytes | None, buckets: int) -> np.ndarray:
    """Buckets of all tokens and of all pairs of neighbours."""
    hashes = word_hashes(_TOKEN.findall(text or b""))
    pairs = mixed(mixed(hashes[:-1]) + hashes[1:])
    return (np.concatenate([mixed(hashes), pairs]) % np.uint64(buckets)).astype(np.int64)


def _counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()):
                total += np.bincount(token_buckets(text.as_py(), buckets), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Token counts of all texts: a vector of fixed length, summed by Spark."""
    parts = texts.select("text").mapInArrow(_counts(buckets), "bucket long, n long")
    found = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray, prior: float = 60.0) -> np.ndarray:
    """Log ratio per bucket; ``prior`` pseudo tokens per bucket pull the target to the raw."""
    share = (raw + 1.0) / (raw.sum() + len(raw))
    weight = prior * len(raw)
    return np.log((target + weight * share) / (target.sum() + weight)) - np.log(share)


def log_weight_of(ratios, buckets: int = BUCKETS):
    """A column function: the log weight of a text. ``ratios`` is a broadcast vector."""

    @F.arrow_udf("double")
    def weigh(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        by_bucket = ratios.value
        for batch in texts:
            yield pa.array(
                [float(by_bucket[token_buckets(t.as_py(), buckets)].sum()) for t in batch.cast(pa.binary())], pa.float64()
            )

    return weigh


def gumbel(seed: int = SEED):
    """Standard Gumbel noise that belongs to a document's id and text, wherever it is computed."""
    bits = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed)), 11)
    return -F.log(-F.log((bits.cast("double") + 0.5) / F.lit(float(1 << 53))))


def kth_largest(scores: DataFrame, name: str, k: int, cells: int = 1024) -> float | None:
    """The k-th largest value of a column, exactly, by ever finer histograms.

    Only ``cells`` counts reach the driver each time; ties are never split.
    """
    if k <= 0:
        return None
    value = F.col(name)
    low, high = scores.agg(F.min(value), F.max(value)).first()
    while low is not None and low < high:
        width = (high - low) / cells
        if width == 0 or low + width == low:
            break
        cell = F.least(F.floor((value - low) / width), F.lit(cells - 1))
        inside = scores.filter((value >= low) & (value <= high))
        counts = inside.groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
        for row in sorted(counts.collect(), key=lambda r: -r["c"]):
            if k <= row["n"]:
                low, high = row["lo"], row["hi"]
                break
            k -= row["n"]
    return high if low is not None and low < high else low


def resampled(docs: DataFrame, labels: DataFrame, least: float = LEAST, prefix: str = "", k: int | None = None) -> DataFrame:
    """All documents with ``log_weight``, ``draw`` (weight plus noise) and ``kept``.

    The ``k`` largest draws are kept, which is a sample without replacement in proportion
    to the weights. Without ``k`` it is the number of documents whose weight reaches
    ``least``, so that it follows the corpus; near that weight the noise decides.

    Needs doc_id and text in ``docs``, doc_id and quality in ``labels``. The columns of
    ``docs`` stay; those of the three new names, with their ``prefix``, are replaced. Null and empty texts have the
    weight 0. Equal rows share noise and fate. Without trusted rows all weights are 0.
    """
    spark = docs.sparkSession
    raw = bucket_counts(docs)
    trusted = bucket_counts(trusted_rows(docs.select("doc_id", "text"), labels))
    ratios = log_ratios(trusted, raw) if trusted.sum() else np.zeros(len(raw))
    weigh = log_weight_of(spark.sparkContext.broadcast(ratios))
    weight, draw, kept = (f"{prefix}{name}" for name in ("log_weight", "draw", "kept"))
    weighed = docs.withColumn(weight, weigh("text"))
    weighed = weighed.withColumn(draw, F.col(weight) + gumbel())
    # two numbers a row: in files of a fair size, not one for each piece of the texts
    keys = staged(weighed.select(weight, draw).hint("rebalance"))
    if k is None:
        k = keys.filter(F.col(weight) >= least).count()
    bar = kth_largest(keys, draw, k)
    drop_staged(keys)
    return weighed.withColumn(kept, F.lit(False) if bar is None else F.col(draw) >= F.lit(bar))


def resampled_only(docs: DataFrame, labels: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents that are drawn, with their own columns."""
    return resampled(docs, labels, least, prefix="__").filter("__kept").select(*docs.columns)
