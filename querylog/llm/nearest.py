"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table of the index has ``k`` functions ``floor((a · x + b) / w)`` with a Gaussian ``a``,
which is 2-stable: a neighbour at distance ``r`` falls ``N(0, r²)`` away from the query
on each of them. The chance that it lies in a cell of one function is therefore known
exactly, and that of a bucket is the product. A query visits the buckets of each table
in descending order of this estimated success, its own and perturbed ones alike, until
the chance of having met the neighbour reaches what a table has to cover. Candidates of all tables are
ranked by their exact Euclidean distance in double precision.

What is fitted, all on bounded samples (``Hashing``): ``r`` from the exact neighbours of
sampled queries, searched among all rows; ``w`` as a multiple of ``r``; ``k`` so that a
bucket holds a set number of rows, from the chance of sampled pairs to collide; and what
a table has to cover, raised until the probes of the sampled queries meet enough of their
exact neighbours. Where that takes too many probes, there are fewer functions and so
larger buckets, down to one function.

Buckets are dealt by hash into shards of bounded size, those with many rows by their rows
as well. A query goes once to each shard in which it visits buckets, and the shard gives
out its nearest rows there, so neither pairs nor candidates are spelled out. A query that
finds fewer rows than asked for, though there are as many, is searched exactly, in blocks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querylog.llm.shared import staged
from querylog.llm.textkit import mixed, signed

_FOUND = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class Hashing:
    """Tables, bucket sizes and the samples that the index is fitted on.

    ``sampled_queries`` and ``sampled_rows`` bound the samples; ``recall`` is what the
    sampled queries have to reach against their exact neighbours.
    """

    tables: int = 4
    width: float = 2.3
    bucket_rows: int = 64
    shard_rows: int = 8192
    split_rows: int = 512
    sampled_queries: int = 128
    sampled_rows: int = 2048
    recall: float = 0.965
    most_functions: int = 10
    seed: int = 7


@dataclass(frozen=True)
class Index:
    """Fitted parameters: small, and the same for every task."""

    directions: np.ndarray  # tables × functions × dimension
    offsets: np.ndarray
    width: float
    reach: float
    cover: float

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """Rows × tables × functions: places in units of the cell width."""
        with np.errstate(over="ignore", invalid="ignore"):
            at = np.einsum("nd,tkd->ntk", vectors, self.directions) / self.width + self.offsets
        return np.clip(np.nan_to_num(at), -1e15, 1e15)

    def keys(self, cells: np.ndarray, table: np.ndarray | int) -> np.ndarray:
        """One 64-bit key per row of cells."""
        out = mixed(np.broadcast_to(np.asarray(table, np.uint64) + np.uint64(1), cells.shape[:-1]).copy())
        for i in range(cells.shape[-1]):
            out = mixed(out + cells[..., i].astype(np.int64).view(np.uint64))
        return out

    def probes(self, place: np.ndarray) -> np.ndarray:
        """Keys of the buckets that a query at these places visits, table by table."""
        spread = self.reach / self.width
        keys = []
        for t, row in enumerate(place):
            own = np.floor(row)
            choices = [_choices(x - c, spread) for x, c in zip(row.tolist(), own.tolist(), strict=True)]
            steps = np.array(list(by_success(choices, self.cover)), np.float64).reshape(-1, len(row))
            keys.append(self.keys(own + steps, t))
        return np.unique(np.concatenate(keys))


def _choices(at: float, spread: float) -> list[tuple[float, int]]:
    """Chances of the cells around a place within its cell, likeliest first."""
    around = max(1, math.ceil(4 * spread))
    edges = [0.5 * math.erf((c - at) / spread / math.sqrt(2)) for c in range(-around, around + 2)]
    found = [(b - a, c) for c, a, b in zip(range(-around, around + 1), edges, edges[1:], strict=False)]
    return sorted((f for f in found if f[0] > 1e-6), reverse=True)


def by_success(choices: list[list[tuple[float, int]]], cover: float) -> Iterator[tuple[int, ...]]:
    """Combinations of one choice each, likeliest first, until their chances add up to ``cover``.

    Every combination is reached in one way, by advancing functions in ascending order.
    """
    first = math.prod(c[0][0] for c in choices)
    heap, covered = [(-first, 0, (0,) * len(choices))], 0.0
    while heap and covered < cover:
        chance, last, taken = heapq.heappop(heap)
        yield tuple(c[i][1] for c, i in zip(choices, taken, strict=True))
        covered -= chance
        for f in range(last, len(choices)):
            i = taken[f]
            if i + 1 < len(choices[f]):
                less = chance / choices[f][i][0] * choices[f][i + 1][0]
                heapq.heappush(heap, (less, f, (*taken[:f], i + 1, *taken[f + 1 :])))


class _Best:
    """The nearest distinct ids of each query, over any number of blocks of rows."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, most: int):
        self.queries, self.ids, self.most = queries, ids, most
        self.squares = (queries**2).sum(axis=1)
        self.limit = np.full(len(ids), np.inf)
        self.kept = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))

    def meet(self, which: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Measure some queries against a block of rows.

        A product of matrices leaves out what is farther than the nearest by more than
        its rounding error; the rest is measured as it is.
        """
        if not len(which) or not len(ids):
            return
        # ids can repeat: as many more rows have to be looked at
        most = self.most + len(ids) - len(np.unique(ids)) + 1
        squares = (vectors**2).sum(axis=1)
        near = self.squares[which][:, None] + squares[None, :] - 2 * (self.queries[which] @ vectors.T)
        slack = 1e-9 * (self.squares[which][:, None] + squares[None, :])
        limit = self.limit[which]
        if len(ids) > most:
            limit = np.minimum(limit, np.partition(near + slack, most - 1, axis=1)[:, most - 1])
        a, b = np.nonzero(near - slack <= limit[:, None])
        a = which[a]
        other = self.ids[a] != ids[b]
        a, b = a[other], b[other]
        exact = np.sqrt(((vectors[b] - self.queries[a]) ** 2).sum(axis=1))
        self._keep(a, exact, ids[b])

    def _keep(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        query, score, ids = (np.concatenate(x) for x in zip(self.kept, (query, score, ids), strict=True))
        order = np.lexsort((score, ids, query))
        query, score, ids = query[order], score[order], ids[order]
        first = np.ones(len(query), bool)
        first[1:] = (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])
        query, score, ids = query[first], score[first], ids[first]
        order = np.lexsort((ids, score, query))
        query, score, ids = query[order], score[order], ids[order]
        starts = np.searchsorted(query, query)
        rank = np.arange(len(query)) - starts
        kept = rank < self.most
        last = rank == self.most - 1
        self.limit[query[last]] = score[last] ** 2
        self.kept = query[kept], score[kept], ids[kept]

    def rows(self) -> pa.RecordBatch:
        query, score, ids = self.kept
        arrays = [pa.array(self.ids[query], pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.float64())]
        return pa.RecordBatch.from_arrays(arrays, names=["query_id", "vec_id", "score"])


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``vec_id`` and ``vec`` of the rows that take part in a search.

    Those are rows with an id and a vector of finite components, not all zero, of the
    dimension that most such rows have (the greater of equally many).
    """
    rows = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("vec", lambda x: x != 0), F.lit(False)))
    sizes = rows.groupBy(F.size("vec").alias("size")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    return rows.filter(F.size("vec") == (most["size"] if most else 0))


def _sample(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` rows by hash of their ids, on the driver."""
    found = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).collect()
    return np.array([r["vec_id"] for r in found], np.int64), np.array([r["vec"] for r in found], np.float64)


def _exact_parts(queries: np.ndarray, ids: np.ndarray, most: int):
    """The nearest rows of a task to a bounded set of queries, with their vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, seen = _Best(queries, ids, most), []
        for batch in batches:
            vectors, found = _matrix(batch.column("vec")), batch.column("vec_id").to_numpy()
            best.meet(np.arange(len(ids)), found, vectors)
            keep = np.isin(found, best.kept[2])
            seen.append((found[keep], vectors[keep]))
        if seen:
            query, score, kept = best.kept
            all_ids, all_vectors = np.concatenate([s[0] for s in seen]), np.concatenate([s[1] for s in seen])
            order = np.argsort(all_ids, kind="stable")
            at = order[np.searchsorted(all_ids[order], kept)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[query]), pa.array(kept), pa.array(score), pa.array(list(all_vectors[at]), pa.list_(pa.float64()))],
                names=["query_id", "vec_id", "score", "vec"],
            )

    return run


def fit(rows: DataFrame, queries: DataFrame, most: int, how: Hashing) -> Index | None:
    """Fit the index on bounded samples of the rows and the queries; None without either."""
    ids, asked = _sample(queries, how.sampled_queries)
    _, sample = _sample(rows, how.sampled_rows)
    if not len(ids) or not len(sample):
        return None
    rng = np.random.default_rng(how.seed)
    nearest = rows.mapInArrow(_exact_parts(asked, ids, most), f"{_FOUND}, vec array<double>")
    nearest = _ranked(nearest, most, "vec").collect()
    farthest: dict[int, float] = {}
    for row in nearest:
        farthest[row["query_id"]] = max(row["score"], farthest.get(row["query_id"], 0.0))
    pairs = np.linalg.norm(sample - sample[rng.permutation(len(sample))], axis=1)
    scale = float(np.median(pairs)) or float(pairs.max()) or 1.0
    reach = max(float(np.quantile(list(farthest.values()) or [scale], 0.95)), 1e-6 * scale)
    width = how.width * reach
    one = np.floor(sample @ rng.normal(size=(sample.shape[1], 64)) / width + rng.uniform(size=64))
    meets = float((one == one[rng.permutation(len(one))]).mean())
    n = rows.count()
    fewer = math.log(max(n / how.bucket_rows, 1.0))
    functions = max(1, min(how.most_functions, math.ceil(fewer / -math.log(min(max(meets, 1e-9), 0.999)))))
    least = 1 - (1 - how.recall) ** (1 / how.tables)
    while True:
        shape = (how.tables, functions)
        directions, offsets = rng.normal(size=(*shape, sample.shape[1])), rng.uniform(size=shape)
        for cover in (least, 1 - 0.7 * (1 - least), 1 - 0.45 * (1 - least), *([0.9, 0.999] if functions == 1 else [])):
            index = Index(directions, offsets, width, reach, cover)
            if _met(index, ids, asked, nearest) >= how.recall:
                return index
        if functions == 1:
            return index
        functions = max(1, functions - 2)


def _met(index: Index, ids: np.ndarray, asked: np.ndarray, nearest: list) -> float:
    """The share of exact neighbours that lie in buckets which their queries visit."""
    if not nearest:
        return 1.0
    keys = _all_keys(index, np.array([r["vec"] for r in nearest]))
    visited = dict(zip(ids.tolist(), map(index.probes, index.places(asked)), strict=True))
    return float(np.mean([np.isin(k, visited[r["query_id"]]).any() for k, r in zip(keys, nearest, strict=True)]))


def _all_keys(index: Index, vectors: np.ndarray) -> np.ndarray:
    cells = np.floor(index.places(vectors))
    return np.stack([index.keys(cells[:, t], t) for t in range(cells.shape[1])], axis=1)


def _keyed(index: Index, probing: bool):
    """Bucket keys of rows, or of what queries visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("vec"))
            keys = list(map(index.probes, index.places(vectors))) if probing else list(_all_keys(index, vectors))
            offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
            flat = signed(np.concatenate(keys)) if keys else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vec"), lists], names=["vec_id", "vec", "keys"])

    return run


def _ranked(found: DataFrame, most: int, *more: str) -> DataFrame:
    """The nearest rows of each query, each id once, with ``rank`` from 1."""
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"), *(F.any_value(m).alias(m) for m in more))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def _shard_search(most: int):
    """The nearest rows of a shard to each of its queries, within the buckets they visit."""

    def body(shard: pa.Table) -> pa.RecordBatch:
        is_query = shard.column("asked").to_numpy()
        asked, rows = shard.filter(pa.array(is_query)), shard.filter(pa.array(~is_query))
        best = _Best(_matrix(asked.column("vec")), asked.column("vec_id").to_numpy(), most)
        lists = asked.column("keys").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        wanted = lists.flatten().to_numpy()
        who = np.repeat(np.arange(len(asked)), np.diff(lists.offsets.to_numpy()))
        order = np.argsort(wanted, kind="stable")
        wanted, who = wanted[order], who[order]
        key = np.concatenate([k.flatten().to_numpy() for k in rows.column("keys").chunks])
        order = np.argsort(key, kind="stable")
        key, ids = key[order], rows.column("vec_id").to_numpy()[order]
        vectors = _matrix(rows.column("vec"))[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True):
            a, b = np.searchsorted(wanted, (key[start], key[start] + 1)) if key[start] < np.iinfo(np.int64).max else (
                np.searchsorted(wanted, key[start]), len(wanted))
            best.meet(who[a:b], ids[start:end], vectors[start:end])
        return best.rows()

    return lambda batches: _by_shard(batches, body)


def _by_shard(batches: Iterator[pa.RecordBatch], body) -> Iterator[pa.RecordBatch]:
    """Apply a function to each run of rows of a shard that has queries and rows."""
    parts: list[pa.RecordBatch] = []
    shard = None

    def ready():
        whole = pa.Table.from_batches(parts)
        asked = whole.column("asked").to_numpy()
        return [body(whole)] if asked.any() and not asked.all() else []

    for batch in batches:
        names = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if end > start:
                if shard is not None and names[start] != shard:
                    yield from ready()
                    parts = []
                shard = names[start]
                parts.append(batch.slice(start, end - start))
    if parts:
        yield from ready()


def _search(rows: DataFrame, queries: DataFrame, index: Index, most: int, how: Hashing) -> DataFrame:
    """Candidates of each query from the buckets that it visits, the nearest of each shard."""
    schema = "vec_id long, vec array<double>, keys array<bigint>"
    rows = rows.mapInArrow(_keyed(index, False), schema).select("vec_id", "vec", F.explode("keys").alias("key"))
    queries = staged(queries.mapInArrow(_keyed(index, True), schema))
    sizes = staged(rows.groupBy("key").agg(F.count("*").alias("n")))
    shards = max(1, math.ceil((sizes.agg(F.sum("n")).first()[0] or 0) / how.shard_rows))
    split = sizes.filter(F.col("n") > how.split_rows).select("key", F.ceil(F.col("n") / how.split_rows).alias("parts"))

    def shard(part: Column) -> Column:
        return F.pmod(F.xxhash64("key", part), F.lit(shards)).cast("int").alias("shard")

    rows = rows.join(split, "key", "left")
    part = F.pmod(F.xxhash64("vec_id", F.lit(how.seed)), F.coalesce("parts", F.lit(1)))
    rows = rows.select(shard(part), F.lit(False).alias("asked"), "vec_id", "vec", F.array("key").alias("keys"))
    visits = queries.select("vec_id", F.explode("keys").alias("key")).join(sizes.select("key"), "key", "left_semi").join(split, "key", "left")
    visits = visits.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)))
    visits = visits.groupBy("vec_id", shard(F.col("part"))).agg(F.collect_set("key").alias("keys"))
    asked = visits.join(queries.select("vec_id", "vec"), "vec_id").select("shard", F.lit(True).alias("asked"), "vec_id", "vec", "keys")
    dealt = rows.unionByName(asked).repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(_shard_search(most), _FOUND)


def _exact(rows: DataFrame, queries: DataFrame, most: int, how: Hashing) -> DataFrame:
    """The nearest of all rows, by blocks of queries that meet blocks of rows."""
    row_blocks = max(1, math.ceil(rows.count() / how.shard_rows))
    query_blocks = max(1, math.ceil(queries.count() / how.shard_rows))

    def dealt(frame: DataFrame, asked: bool, own: int, other: int) -> DataFrame:
        block = F.pmod(F.xxhash64("vec_id", F.lit(how.seed)), F.lit(own))
        met = frame.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other - 1).cast("long"))))
        r, q = (F.col("other"), F.col("own")) if asked else (F.col("own"), F.col("other"))
        shard = (q * row_blocks + r).cast("int")
        return met.select(shard.alias("shard"), F.lit(asked).alias("asked"), "vec_id", "vec", F.array(F.lit(0).cast("long")).alias("keys"))

    both = dealt(rows, False, row_blocks, query_blocks).unionByName(dealt(queries, True, query_blocks, row_blocks))
    return both.repartition("shard").sortWithinPartitions("shard").mapInArrow(_shard_search(most), _FOUND)


def nearest_neighbours(
    rows: DataFrame, queries: DataFrame, most: int = 10, key: str = "vec_id", vector: str = "embedding", how: Hashing | None = None
) -> DataFrame:
    """The ``most`` nearest rows found for each query, of all rows but its own.

    ``rows`` and ``queries`` have the columns ``key`` (an integer) and ``vector``; others
    are ignored. Returns ``query_id``, ``rank`` from 1, ``vec_id`` and ``score``, the
    Euclidean distance in double precision, nearest first and ties to the smaller id.
    Fewer rows come only if there are fewer.

    Rows without an id or with a null, zero or non-finite vector, or one of another
    dimension than most, take no part, as queries neither. Rows of one id are one item,
    at the distance of the nearest of them. Empty tables give no rows.
    """
    how = how or Hashing()
    rows = usable(rows, key, vector)
    queries = staged(usable(queries, key, vector))
    index = fit(rows, queries, most, how)
    if index is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = staged(_ranked(_search(rows, queries, index, most, how), most))
    others = rows.agg(F.count_distinct("vec_id")).first()[0] - 1
    short = queries.join(found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n")), "vec_id", "left")
    short = short.filter(F.coalesce("n", F.lit(0)) < min(most, others)).select("vec_id", "vec")
    if short.isEmpty():
        return found.select("query_id", "rank", "vec_id", "score")
    whole = _ranked(_exact(rows, short, most, how), most)
    found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti")
    return found.unionByName(whole).select("query_id", "rank", "vec_id", "score")
