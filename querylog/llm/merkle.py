"""A Merkle manifest of a table: leaf digests, roots and inclusion proofs.

The rows of a tree (here of one language) are numbered in order without a window over
the tree: a range partitioning sorts them, and the place of a row is its place in its
partition plus the sizes of the partitions before. From then on rows lie in blocks of
``FANOUT ** LEVELS`` neighbours, whatever tree they belong to.

Inside a block all levels are found with lag and lead columns of fixed offsets. On level
``l`` a node sits on the row of its first leaf, every ``FANOUT ** l`` rows. Its siblings
are lags and leads by multiples of that stride, masked by its slot among its siblings;
a short last run gives null beyond its end. The first child hashes its run into the
parent, which so comes to sit on the same row. What siblings a node has is filled down
to its leaves. The top nodes of the blocks are rows of the next round, until each tree
has one node; those are the leaves of a last tree in the same way. Rounds grow with the
logarithm of the table, and each has a block's share of the rows of the one before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querylog.llm.shared import ascii_lower, staged

FANOUT = 8
LEVELS = 3  # levels that are climbed within a block
BLOCK = FANOUT**LEVELS
#: The columns that make up a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def encoded(value: Column) -> Column:
    """A value as its byte count, a colon and its text; ``-`` for null."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Sequence[Column]) -> Column:
    return digest(F.concat(*map(encoded, values)))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, leaf, lambda h, step: digest(F.concat(step["left"], h, step["right"])))


def proof_digest(path: Column) -> Column:
    """One digest over all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""))


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with ``pos``, their place in their tree, and ``total``, the rows of the tree."""
    laid = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    laid = staged(laid.withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    parts = laid.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "tree", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy("tree")).alias("total"),
    )
    placed = laid.join(parts, ["tree", "part"]).withColumn("pos", F.col("at") - F.col("first") + F.col("before"))
    return placed.drop("at", "part", "first", "before")


def _in_blocks(nodes: DataFrame) -> DataFrame:
    """Adds ``block``, ``path`` up to the block's top, and ``top``, on its first row alone."""
    rows = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK)).withColumn("h0", F.col("hash"))
    within = Window.partitionBy("tree", "block").orderBy("pos")
    for level in range(LEVELS):
        stride = FANOUT**level
        own = F.col(f"h{level}")
        slot = F.floor(F.col("pos") / stride) % FANOUT
        left = [F.when(slot >= i, F.lag(own, i * stride).over(within)) for i in range(FANOUT - 1, 0, -1)]
        right = [F.when(slot + i < FANOUT, F.lead(own, i * stride).over(within)) for i in range(1, FANOUT)]
        is_node, climbs = F.col("pos") % stride == 0, F.col("total") > stride
        rows = rows.withColumns({
            "left": F.concat_ws("", *left), "right": F.concat_ws("", *right),
        }).withColumns({
            f"s{level}": F.when(is_node & climbs, F.struct("left", "right")),
            f"h{level + 1}": F.when(
                is_node & (slot == 0), F.when(climbs, digest(F.concat(own, F.col("right")))).otherwise(own)
            ),
        }).drop("left", "right", own)
    down = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = [F.last(f"s{level}", ignorenulls=True).over(down) for level in range(LEVELS)]
    rows = rows.withColumn("path", F.filter(F.array(*steps), lambda step: step.isNotNull()))
    return rows.withColumnRenamed(f"h{LEVELS}", "top").drop(*(f"s{level}" for level in range(LEVELS)))


def _climbed(nodes: DataFrame, most: int) -> DataFrame:
    """Nodes with ``path``, their siblings up to the top of their tree, and ``root``.

    ``nodes`` has ``tree``, ``pos``, ``total`` and ``hash``; ``most`` is the largest total.
    """
    here = _in_blocks(nodes)
    tops = here.filter(F.col("pos") % BLOCK == 0).select("tree", "block", "total", F.col("top").alias("hash"))
    if most > BLOCK:
        above = tops.select("tree", F.col("block").alias("pos"), F.ceil(F.col("total") / BLOCK).alias("total"), "hash")
        tops = _climbed(above, -(-most // BLOCK)).select("tree", F.col("pos").alias("block"), F.col("path").alias("up"), "root")
    else:
        tops = tops.select("tree", "block", F.lit(None).cast("array<struct<left:string,right:string>>").alias("up"), F.col("hash").alias("root"))
    rows = here.drop("top").join(tops, ["tree", "block"])
    path = F.when(F.col("up").isNull(), F.col("path")).otherwise(F.concat("path", "up"))
    return rows.withColumn("path", path).drop("up", "block")


def manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, tree: str = "lang", key: str = "doc_id", presented: dict[str, Column] | None = None
) -> DataFrame:
    """Leaf, path and roots of every row.

    Returns ``key``, ``leaf`` (the digest of ``fields``), ``presented_leaf`` (the same
    with the columns in ``presented`` replaced: what somebody now holds), ``path``
    (siblings from the leaf to the root, as structs of the digests to the left and to the
    right), ``subroot`` of its tree and ``root`` of all. Other columns are ignored, whatever
    their names.

    A null is a value of its own in leaves, keys and trees, and comes first. Rows of one
    key are ordered by leaf; repeated rows are leaves of their own, next to each other.
    An empty text is a text of no bytes. A tree of one row is its leaf; an empty table
    has no rows and no root.
    """
    presented = presented or {}
    name = F.col(tree).cast("string")
    leaves = staged(docs.select(
        F.when(name.isNull(), "").otherwise(F.concat(F.lit("."), name)).alias("tree"), F.col(key).alias("key"),
        leaf_digest([F.col(f) for f in fields]).alias("hash"),
        leaf_digest([presented.get(f, F.col(f)) for f in fields]).alias("presented"),
    ))
    leaves = _numbered(leaves, "key", "hash")
    rows = _climbed(leaves, leaves.agg(F.max("total")).first()[0] or 0)
    subroots = staged(rows.filter("pos = 0").select(F.col("tree").alias("name"), F.col("root").alias("hash")).withColumn("tree", F.lit("")))
    subroots = _numbered(subroots, "name")
    roots = _climbed(subroots, subroots.count()).select(
        F.col("name").alias("tree"), F.col("hash").alias("subroot"), F.col("path").alias("last"), F.col("root").alias("whole")
    )
    return rows.join(roots, "tree").select(
        F.col("key").alias(key), F.col("hash").alias("leaf"), F.col("presented").alias("presented_leaf"),
        F.concat("path", "last").alias("path"), "subroot", F.col("whole").alias("root"),
    )


def lowered_by_chance(key: str = "doc_id", text: str = "text") -> Column:
    """The text with A to Z lower-cased where 3 divides the CRC of the key, else as it is."""
    hit = F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 0
    return F.when(hit, ascii_lower(F.col(text))).otherwise(F.col(text))
