"""From raw documents to a training mixture, in five stages.

Every stage is written as Parquet to the shared folder and read again by the next.
Documents leave that are not drawn towards trusted text, are predicted toxic, repeat
another document, or hold a benchmark passage. What remains carries the rate at which
the mixture uses it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylog.llm.decontamination import decontaminated
from querylog.llm.importance import resampled_only
from querylog.llm.mixing import mixed_rates
from querylog.llm.near_duplicates import deduplicated
from querylog.llm.registered import TARGETS, labelled_domains
from querylog.llm.shared import staged, table
from querylog.llm.toxicity import not_toxic


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn towards trusted text. Empty ones weigh nothing and may stay;
    equal rows share their fate; no documents give none."""
    return resampled_only(docs, table(spark, sf_dir, "labels"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic; all, if labels of one class alone are left."""
    return not_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Word shingles of five, at a similarity of 0.8; documents without words all stay."""
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark; empty ones have none."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates towards target shares of languages; documents of the rate 0 leave.

    ``copies`` is the rate rounded down or up, up as often as its fraction says.
    """
    known = labelled_domains(docs, table(spark, sf_dir, "labels"))
    rated = mixed_rates(docs, known, TARGETS).drop("shares").filter("rate > 0")
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit(23)), F.lit(1 << 20)) / float(1 << 20)
    up = (chance < F.col("rate") - F.floor("rate")).cast("long")
    return rated.withColumn("copies", F.floor("rate") + up)


STAGES = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]
#: SQL cannot train a convolutional network; tests use a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
