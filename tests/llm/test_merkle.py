"""Merkle manifests against a plain tree."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from querylog.llm.merkle import FIELDS, folded, lowered_by_chance, manifest, proof_digest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return digest("".join("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS))


def climbed(nodes):
    """The root, and for each node its steps of left and right siblings."""
    steps, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, over = [], []
        for at in range(0, len(nodes), 8):
            run = nodes[at : at + 8]
            for j in range(len(run)):
                for leaf in under[at + j]:
                    steps[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
            above.append(digest("".join(run)))
            over.append([x for u in under[at : at + 8] for x in u])
        nodes, under = above, over
    return nodes[0], steps


def plain_manifest(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row["lang"], []).append((row["doc_id"], leaf_of(row), row))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    found = []
    for name in names:
        tree = sorted(trees[name], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        found.append((tree, *climbed([x[1] for x in tree])))
    if not found:
        return []
    root, last = climbed([f[1] for f in found])
    out = []
    for (tree, subroot, steps), more in zip(found, last, strict=True):
        for (doc_id, leaf, row), path in zip(tree, steps, strict=True):
            now = leaf
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and row["text"] is not None:
                now = leaf_of({**row, "text": "".join(c.lower() if "A" <= c <= "Z" else c for c in row["text"])})
            reached = now
            for left, right in path + more:
                reached = digest(left + reached + right)
            proof = digest("".join(left + right for left, right in path + more))
            out.append((doc_id, leaf, subroot, root, proof, reached, reached == root))
    return out


def answers(docs):
    rows = manifest(docs, presented={"text": lowered_by_chance()})
    reached = folded(F.col("presented_leaf"), F.col("path"))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof"), reached.alias("reached"),
        (reached == F.col("root")).alias("verified"),
    )


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


def made(n, langs, seed=3):
    rng = random.Random(seed)
    names = [None, "", *(f"l{i}" for i in range(langs))] if langs > 1 else ["en"]
    rows = [
        (rng.randrange(2 * n) if rng.random() < 0.1 else i, rng.choice([None, "", "A b", "ÄX"]), rng.choice(names), "s", rng.choice([None, 3]))
        for i in range(n)
    ]
    return rows + rows[:3]  # repeated rows are leaves of their own


# one row, a full run, one more, whole and broken blocks, a third level of blocks, many trees
@pytest.mark.parametrize(("n", "langs"), [(1, 1), (8, 1), (9, 2), (509, 1), (510, 1), (700, 30), (5_000, 1), (300, 300)])
def test_equals_a_plain_tree(spark, n, langs):
    rows = made(n, langs)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    expected = plain_manifest([dict(zip(names, r, strict=True)) for r in rows])
    assert in_order(answers(spark.createDataFrame(rows, SCHEMA)).collect()) == in_order(expected)


def test_hot_tree_is_split(spark):
    rows = manifest(spark.range(5_000).select(F.col("id").alias("doc_id"), *(F.lit("x").alias(c) for c in FIELDS[1:])))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert "hashpartitioning(tree" in plan and "block" in plan
    assert rows.agg(F.count_distinct("root"), F.count("*")).first() == (1, 5_000)


def test_edges(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert answers(nothing).collect() == []
    rows = [(None, None, None, None, None), (None, "", "", "", 0), (1, "long " * 50_000, "en", "s", 1), (1, "long " * 50_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs = docs.withColumns({name: F.lit(name) for name in ("tree", "key", "hash", "path", "root", "pos", "block", "part", "at", "leaf", "left", "top")})
    found = answers(docs).collect()
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    assert in_order(found) == in_order(plain_manifest([dict(zip(names, r, strict=True)) for r in rows]))


def test_any_change_is_noticed(spark):
    docs = spark.createDataFrame(made(60, 3), SCHEMA)
    for column, value in (("text", "other"), ("source", None), ("n_chars", 4), ("doc_id", -5)):
        rows = manifest(docs, presented={column: F.lit(value).cast(docs.schema[column].dataType)})
        same = rows.filter(folded(F.col("presented_leaf"), F.col("path")) == F.col("root"))
        assert same.filter("leaf != presented_leaf").count() == 0
        assert rows.filter("leaf != presented_leaf").count() > 0
