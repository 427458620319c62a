"""Rates per document that bring soft domains to target token shares.

A multinomial model over hashed words, fitted on labelled rows, gives every document
a posterior over domains, softened by the root of its length: membership is a matter
of degree. The rates ``r >= 0`` of the documents minimise

    |sum_i r_i t_i p_i - T b|^2 / T^2 + ridge * sum_i t_i (r_i - 1)^2 / T

for tokens t, posteriors p, targets b and all tokens T. Projected gradient steps are
taken in the metric of the tokens, so one step needs only the domain totals of the
last one: a job per step sums a vector of one number per domain over all documents,
and every task repeats the short history of such vectors for its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylog.llm.shared import drop_staged, staged
from querylog.llm.textkit import mixed, plain_words, word_hashes

BUCKETS = 1 << 14


@dataclass(frozen=True)
class Mixing:
    """``most_labelled`` rows at most are fitted; ``steps`` bounds the gradient steps."""

    most_labelled: int = 10_000
    steps: int = 60
    ridge: float = 0.01
    close: float = 1e-7
    buckets: int = BUCKETS


def _buckets(text: bytes | None, buckets: int) -> np.ndarray:
    return (mixed(word_hashes(plain_words(text))) % np.uint64(buckets)).astype(np.int64)


def _domain_counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for domain, text in zip(batch.column("domain"), batch.column("text").cast(pa.binary()), strict=True):
                own = totals.setdefault(domain.as_py(), np.zeros(buckets, np.int64))
                own += np.bincount(_buckets(text.as_py(), buckets), minlength=buckets)
        for domain, total in totals.items():
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([domain] * len(seen), pa.string()), pa.array(seen), pa.array(total[seen])],
                names=["domain", "bucket", "n"],
            )

    return run


def _posterior(logs: np.ndarray, prior: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    score = prior + logs[:, hashed].sum(axis=1) / np.sqrt(max(1, len(hashed)))
    score = np.exp(score - score.max())
    return score / score.sum()


def _memberships(model, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, prior = model.value
        for batch in batches:
            tokens, shares = [], []
            for text in batch.column("text").cast(pa.binary()):
                hashed = _buckets(text.as_py(), buckets)
                tokens.append(len(hashed)), shares.append(_posterior(logs, prior, hashed))
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens, pa.int64()), pa.array(shares, pa.list_(pa.float64()))], names=["tokens", "shares"]
            )

    return run


def rates_after(shares: np.ndarray, history: np.ndarray, step: float, ridge: float) -> np.ndarray:
    """Rates of some documents after the steps whose residual vectors are given."""
    rate = np.ones(len(shares))
    for residual in history:
        rate = np.maximum(0.0, rate - step * (shares @ residual + ridge * (rate - 1)))
    return rate


def _totals(history: np.ndarray, step: float, ridge: float):
    """Domain totals of a task's documents under the present rates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(history.shape[1])
        for batch in batches:
            shares = batch.column("shares").flatten().to_numpy().reshape(batch.num_rows, -1)
            tokens = batch.column("tokens").to_numpy()
            total += (rates_after(shares, history, step, ridge) * tokens) @ shares
        domains = np.arange(len(total), dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(domains), pa.array(total)], names=["domain", "total"])

    return run


def domain_model(docs: DataFrame, labelled: DataFrame, how: Mixing) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Domains, log word probabilities per domain, and log priors.

    ``labelled`` has doc_id and domain. A row with two domains counts for both.
    """
    some = labelled.filter("doc_id IS NOT NULL AND domain IS NOT NULL").select("doc_id", "domain").distinct()
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(how.most_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("domain", "text")
    counts = rows.mapInArrow(_domain_counts(how.buckets), "domain string, bucket long, n long")
    counts = counts.groupBy("domain", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(counts.column("domain").to_pylist(), dtype=object)
    domains = sorted(set(names))
    table = np.full((len(domains), how.buckets), 0.5)
    for k, domain in enumerate(domains):
        own = names == domain
        table[k, counts.column("bucket").to_numpy()[own]] += counts.column("n").to_numpy()[own]
    logs = np.log(table / table.sum(axis=1, keepdims=True)) if domains else table
    return domains, logs, np.zeros(len(domains))


def mixed_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], how: Mixing | None = None) -> DataFrame:
    """All documents with ``tokens``, ``shares`` (per domain in order of name) and ``rate``.

    Needs doc_id and text in ``docs``, whose columns stay but for those three names. ``targets`` are shares of
    tokens, brought to the sum of one over the domains that labelled rows know; a
    domain without a target has the target 0. Null and empty texts have no tokens and
    rate as their prior says. Without labelled rows, tokens or targets all rates are 1.
    """
    how, spark = how or Mixing(), docs.sparkSession
    domains, logs, prior = domain_model(docs, labelled, how)
    aim = np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
    if not domains or not aim.sum():
        empty = F.array().cast("array<double>")
        return docs.withColumns({"tokens": F.lit(0).cast("long"), "shares": empty, "rate": F.lit(1.0)})
    aim /= aim.sum()
    model = spark.sparkContext.broadcast((logs.astype(np.float32), prior))
    members = staged(
        docs.select("text").mapInArrow(_memberships(model, how.buckets), "tokens long, shares array<double>")
    )
    cells = [F.sum(F.col("tokens") * F.col("shares")[j] * F.col("shares")[k]) for j in range(len(aim)) for k in range(len(aim))]
    whole, *gram = members.agg(F.sum("tokens"), *cells).first()
    history, step = np.zeros((0, len(aim))), 0.0
    if whole:
        step = 1.0 / (np.linalg.eigvalsh(np.array(gram).reshape(len(aim), -1) / whole).max() + how.ridge)
        for _ in range(how.steps):
            sums = members.mapInArrow(_totals(history, step, how.ridge), "domain int, total double")
            sums = sums.groupBy("domain").agg(F.sum("total").alias("total")).orderBy("domain").collect()
            residual = np.round(np.array([r["total"] for r in sums]) / whole - aim, 12)
            last = history[-1] if len(history) else None
            history = np.vstack([history, residual])
            if last is not None and np.abs(residual - last).max() < how.close:
                break
    drop_staged(members)

    result = "tokens: long, shares: array<double>, rate: double"

    @F.arrow_udf(f"struct<{result}>")
    def rated(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        logs, prior = model.value
        for batch in texts:
            hashed = [_buckets(t.as_py(), how.buckets) for t in batch.cast(pa.binary())]
            shares = np.array([_posterior(logs, prior, h) for h in hashed]).reshape(len(hashed), len(prior))
            yield pa.StructArray.from_arrays(
                [
                    pa.array([len(h) for h in hashed], pa.int64()),
                    pa.array(list(shares), pa.list_(pa.float64())),
                    pa.array(rates_after(shares, history, step, how.ridge)),
                ],
                names=["tokens", "shares", "rate"],
            )

    others = [c for c in docs.columns if c not in ("tokens", "shares", "rate")]
    return docs.withColumn("__rated", rated("text")).select(*others, "__rated.*")
