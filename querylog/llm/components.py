"""Connected components by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylog.llm.shared import drop_staged, staged


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the smallest node of each neighbourhood.

    The large star moves the larger neighbours of a node, the small star the smaller
    ones and the node itself. Sums are combined before the shuffle, so a node with
    very many neighbours is one row per task.
    """
    if large:
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        ways = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = ways.join(least, "a")
    if large:
        out = moved.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return out.filter("a != b").distinct()


def component_labels(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node reachable, for all nodes of an edge list.

    ``edges`` has the columns a and b. Nodes whose label is their own are left out
    unless they have neighbours, in which case they are the label of those. Rounds
    grow with the logarithm of the graph; each is written to the shared folder.
    """
    edges = staged(edges.filter("a != b").select("a", "b").distinct())
    seen = None
    while True:
        after = staged(_stars(_stars(edges, large=True), large=False))
        drop_staged(edges)
        edges = after
        mark = edges.agg(
            F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if mark == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
        seen = mark
