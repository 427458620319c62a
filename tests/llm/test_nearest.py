"""Nearest neighbours against brute force."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from querylog.llm.nearest import Hashing, _Best, by_success, nearest_neighbours
from querylog.llm.registered import op13_nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>"


def frame(spark, ids, vectors):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def exact(ids, vectors, query_id, most=10):
    own = ids == query_id
    score = np.sqrt(((vectors - vectors[own][0]) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, score)) if not own[i]][:most]
    return [(int(ids[i]), float(score[i])) for i in order]


def by_query(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert all([r["rank"] for r in rows if r["query_id"] == q] for q in found)
    return found


def recall(found, expected):
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in e}) for q, e in expected.items())
    return hits / sum(map(len, expected.values()))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_recall(spark, sf):
    rows = op13_nearest_neighbours(spark, f"/root/testdata/{sf}").collect()
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").toPandas()
    ids, vectors = table["vec_id"].to_numpy(), np.stack(table["embedding"]).astype(np.float64)
    expected = {int(q): exact(ids, vectors, q) for q in ids[ids % 100 == 0]}
    found = by_query(rows)
    assert found.keys() == expected.keys() and all(len(f) == 10 for f in found.values())
    assert recall(found, expected) >= 0.93
    at = {int(i): v for i, v in zip(ids, vectors, strict=True)}
    for q, pairs in found.items():
        assert pairs == sorted(pairs, key=lambda p: (p[1], p[0]))
        assert all(s == pytest.approx(float(np.linalg.norm(at[q] - at[i])), abs=1e-12) for i, s in pairs)


def test_clusters_scales_and_copies(spark):
    """Tight groups, groups far apart, thousands of copies: ties go to the smaller id."""
    rng = np.random.default_rng(5)
    parts = [c + s * rng.normal(size=(400, 24)) for c, s in ((0, 1), (50, 0.01), (-900, 3))]
    vectors = np.concatenate([*parts, np.full((2_000, 24), 7.0)]).astype(np.float32).astype(np.float64)
    ids = rng.permutation(len(vectors)).astype(np.int64)
    rows = frame(spark, ids, vectors)
    found = by_query(nearest_neighbours(rows, rows.filter("vec_id % 50 = 0")).collect())
    expected = {int(q): exact(ids, vectors, q) for q in ids[ids % 50 == 0]}
    assert found.keys() == expected.keys() and all(len(f) == 10 for f in found.values())
    assert recall(found, expected) >= 0.9
    copies = set(ids[-2_000:].tolist())
    for q in copies & found.keys():
        assert found[q] == expected[q]  # all at distance 0, the ten smallest ids


def test_few_rows_are_all_found(spark):
    vectors = np.eye(6) + 0.1
    rows = frame(spark, range(6), vectors)
    found = by_query(nearest_neighbours(rows, rows).collect())
    expected = {q: exact(np.arange(6), vectors.astype(np.float32).astype(np.float64), q) for q in range(6)}
    assert {q: [i for i, _ in f] for q, f in found.items()} == {q: [i for i, _ in e] for q, e in expected.items()}


def test_a_query_far_from_all_others_is_still_answered(spark):
    rng = np.random.default_rng(2)
    vectors = np.concatenate([rng.normal(size=(600, 8)), [[1e4] * 8], [[-1e6] * 8]])
    rows = frame(spark, range(602), vectors)
    vectors = vectors.astype(np.float32).astype(np.float64)
    found = by_query(nearest_neighbours(rows, rows.filter("vec_id % 50 = 0 OR vec_id >= 600"), how=Hashing(sampled_queries=8)).collect())
    for q in (600, 601):
        assert [i for i, _ in found[q]] == [i for i, _ in exact(np.arange(602), vectors, q)]


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame(
        [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]),
         (7, []), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, [0.0, 2.0]), (9, [0.0, 9.0]), (100, [3.0, 0.0])],
        SCHEMA,
    )
    rows = rows.withColumns({name: F.lit(name) for name in ("key", "keys", "vec", "score", "rank", "shard", "asked", "query_id", "n", "parts")})
    found = by_query(nearest_neighbours(rows, rows.filter("coalesce(vec_id, 0) % 100 = 0 OR vec_id = 9")).collect())
    assert {q: [i for i, _ in f] for q, f in found.items()} == {0: [1, 100, 9], 100: [0, 1, 9], 9: [1, 0, 100]}
    assert [s for _, s in found[0]] == pytest.approx([math.sqrt(2), 2.0, math.sqrt(5)])
    nothing = rows.limit(0)
    assert nearest_neighbours(nothing, nothing).collect() == []
    assert nearest_neighbours(rows, nothing).collect() == []
    alone = rows.filter("vec_id = 0")
    assert nearest_neighbours(alone, alone).collect() == []


def test_buckets_come_in_order_of_success():
    rng = np.random.default_rng(1)
    choices = [sorted(((float(p), c) for c, p in enumerate(rng.dirichlet(np.ones(4)))), reverse=True) for _ in range(5)]
    chance = [dict((c, p) for p, c in one) for one in choices]
    found = list(by_success(choices, 0.9))
    product = [math.prod(chance[i][c] for i, c in enumerate(cells)) for cells in found]
    assert product == sorted(product, reverse=True) and len(set(found)) == len(found)
    everything = sorted((math.prod(chance[i][c] for i, c in enumerate(x)) for x in itertools.product(range(4), repeat=5)), reverse=True)
    needed = int(np.searchsorted(np.cumsum(everything), 0.9)) + 1
    assert abs(len(found) - needed) <= 1


def test_best_keeps_exact_order_over_blocks():
    rng = np.random.default_rng(4)
    queries, vectors = rng.normal(size=(5, 6)), np.repeat(rng.normal(size=(60, 6)), 3, axis=0)
    ids = rng.permutation(180).astype(np.int64)
    best = _Best(queries, np.array([-1, -2, -3, -4, -5]), 7)
    for at in range(0, 180, 25):
        best.meet(np.arange(5), ids[at : at + 25], vectors[at : at + 25])
        best.meet(np.array([0, 3]), ids[at : at + 25], vectors[at : at + 25])  # a table that finds the same
    rows = best.rows().to_pylist()
    for q in range(5):
        score = np.sqrt(((vectors - queries[q]) ** 2).sum(axis=1))
        expected = [int(ids[i]) for i in np.lexsort((ids, score))[:7]]
        assert [r["vec_id"] for r in rows if r["query_id"] == -1 - q] == expected
