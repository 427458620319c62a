"""Near-duplicate documents by fast similarity sketches, banding and exact checks.

Every text becomes its set of word shingles. Texts of equal sets are one class, and
one class is compared once, however many copies it has. A class is sketched in
rounds: each round throws every shingle into one of ``coordinates`` bins, a bin keeps
the smallest hash of the earliest round that reached it, and after as many rounds as
there are bins each further round serves one bin with all shingles. So every
coordinate fills, and the share of equal coordinates of two sketches estimates their
Jaccard similarity with Chernoff-like tails.

Bands of ``rows`` coordinates are joined into buckets. Pairs are not spelled out
inside a bucket: first, in rounds, every class meets one leader of its buckets, and
confirmed links merge components. Then only buckets that hold more than one component
are left. Buckets of more members than a block that share members are put together, so
that classes which share many of them meet once. Members are compared across components,
inside tasks, in blocks of bounded size, each pair of small buckets in the first band
that it shares: first by sketch, then, for what can still be a link, on full sets.
Members of a group's largest component do not meet each other there. A block gives out
no more links than connect its members. Every link is confirmed on full sets, made
again from whole texts.

Classes by the thousand that are all about as similar as the threshold, without being
linked, take comparisons by their number times that of the bucket; nothing else does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylog.llm.blocks import by_group, compared, dealt_in_blocks, first_met, regrouped, shared_counts, spanning
from querylog.llm.components import component_labels
from querylog.llm.shared import SPACED_WORD, row_key, staged
from querylog.llm.textkit import mixed, shingle_set, signed, spaced_words


_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Sketching:
    """Shingle length, similarity as a percentage, and the shape of the sketch.

    With 48 bands of 6 coordinates a pair at 80 % misses every band once in two
    million. The sketch spares exact checks of pairs six standard deviations below the
    similarity. ``turns`` bounds the rounds with leaders, ``block`` the groups after them.
    """

    shingle_words: int = 5
    percent: int = 80
    bands: int = 48
    rows: int = 6
    seed: int = 1
    turns: int = 6
    block: int = 512

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows

    @property
    def least_equal(self) -> int:
        """Equal coordinates below which a pair is not worth an exact check."""
        share = self.percent / 100
        spread = math.sqrt(share * (1 - share) / self.coordinates)
        return int(self.coordinates * max(0.0, share - 6 * spread))


def fast_sketch(shingles: np.ndarray, bins: int, seed: int) -> np.ndarray:
    """One 64-bit coordinate per bin: the round in the high bits, then the least hash."""
    sketch = np.full(bins, _EMPTY)
    done, n = 0, len(shingles)
    at_once = min(int(1.2 * bins * math.log(bins + 1) / n) + 1, 2_000_000 // n + 1)
    while done < bins and (sketch == _EMPTY).any():
        rounds = np.arange(done, min(bins, done + at_once), dtype=np.uint64)
        hashed = mixed(shingles[None, :] + mixed(rounds + np.uint64((seed << 20) + 1))[:, None])
        value = (rounds << np.uint64(50))[:, None] | (mixed(hashed) >> np.uint64(14))
        np.minimum.at(sketch, (hashed % np.uint64(bins)).astype(np.intp).ravel(), value.ravel())
        done += len(rounds)
    for i in np.flatnonzero(sketch == _EMPTY):
        last = mixed(shingles + mixed(np.array([bins + i + (seed << 20) + 1], np.uint64)))
        sketch[i] = np.uint64(bins + i) << np.uint64(50) | (mixed(last) >> np.uint64(14)).min()
    return sketch


def band_hashes(sketch: np.ndarray, bands: int) -> np.ndarray:
    rows = sketch.reshape(bands, -1)
    out = mixed(np.arange(1, bands + 1, dtype=np.uint64))
    for i in range(rows.shape[1]):
        out = mixed(out + rows[:, i])
    return out


def _sketches(how: Sketching):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            sizes, classes, bands, brief = [], [], [], []
            for value in texts:
                shingles = shingle_set(spaced_words(value.as_py()), how.shingle_words)
                sizes.append(len(shingles))
                if not len(shingles):
                    classes.append(None), bands.append(None), brief.append(None)
                    continue
                sketch = fast_sketch(shingles, how.coordinates, how.seed)
                classes.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                bands.append(signed(band_hashes(sketch, how.bands)))
                brief.append((sketch & np.uint64(0xFF)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("row_key"),
                    pa.array(sizes, pa.int64()),
                    pa.array(classes, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(brief, pa.binary()),
                ],
                names=["doc_id", "row_key", "n_shingles", "class", "bands", "brief"],
            )

    return run


def _confirmed(how: Sketching):
    """Of pairs with both texts, those whose full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, last, left = [], None, None
            texts = (batch.column(name).cast(pa.binary()) for name in ("text_a", "text_b"))
            for a, b in zip(*texts, strict=True):
                a = a.as_py()
                if a != last:
                    last, left = a, shingle_set(spaced_words(a), how.shingle_words)
                right = shingle_set(spaced_words(b.as_py()), how.shingle_words)
                both = len(np.intersect1d(left, right, assume_unique=True))
                linked.append(100 * both >= how.percent * (len(left) + len(right) - both))
            kept = batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))
            yield kept

    return run


def _equal_bytes(a, b):
    """Equal positions of two byte strings of one length."""

    @F.arrow_udf("int")
    def count(left: pa.Array, right: pa.Array) -> pa.Array:
        if not len(left):
            return pa.array([], pa.int32())
        return pa.array((_grid(left) == _grid(right)).sum(axis=1).astype(np.int32))

    return count(a, b)


def _grid(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _plausible(how: Sketching):
    """Of each group the members that may have a link, judged by sketch and size."""

    def body(group: pa.Table) -> pa.RecordBatch | None:
        if group.num_rows < 2:
            return None
        size = group.column("n_shingles").to_numpy()
        pairs = compared(group)
        pairs &= np.minimum.outer(size, size) * 100 >= np.maximum.outer(size, size) * how.percent
        if not group.column("joint")[0].as_py():
            bands = group.column("bands").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
            pairs = first_met(bands, group.column("bucket")[0].as_py(), pairs)
        if not pairs.any():
            return None
        brief, found = _grid(group.column("brief")), set()
        left, right = np.nonzero(pairs)
        for i in range(0, len(left), 20_000):
            a, b = left[i : i + 20_000], right[i : i + 20_000]
            near = (brief[a] == brief[b]).sum(axis=1) >= how.least_equal
            found.update(a[near].tolist(), b[near].tolist())
        if not found:
            return None
        kept = group.select(["bucket", "bi", "bj", "block", "class", "label"]).take(sorted(found))
        return kept.combine_chunks().to_batches()[0]

    return lambda batches: by_group(batches, body)


def _linked(how: Sketching):
    """Links of each group, confirmed on full sets: enough to connect its members."""

    def body(group: pa.Table) -> pa.RecordBatch | None:
        sets = [shingle_set(spaced_words(t), how.shingle_words) for t in group.column("text").cast(pa.binary()).to_pylist()]
        both, size = shared_counts(sets), np.array([len(s) for s in sets])
        links = spanning(compared(group) & (100 * both >= how.percent * (np.add.outer(size, size) - both)))
        if not links:
            return None
        names = group.column("class").to_pylist()
        ends = [[names[pair[k]] for pair in links] for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(e, pa.binary()) for e in ends], names=["a", "b"])

    return lambda batches: by_group(batches, body)


class _Linker:
    """Grows components over classes, testing pairs from shared buckets."""

    def __init__(self, classes: DataFrame, entries: DataFrame, texts: DataFrame, how: Sketching):
        self.classes, self.entries, self.texts, self.how = classes, entries, texts, how
        self.labels: DataFrame | None = None

    def open_entries(self) -> DataFrame:
        """Members of the buckets that hold more than one component."""
        if self.labels is None:
            return self.entries.withColumn("label", F.col("class"))
        entries = self.entries.join(self.labels, "class", "left")
        entries = entries.withColumn("label", F.coalesce("label", "class"))
        open_ = entries.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
        return entries.join(open_.filter("lo != hi").select("bucket"), "bucket", "left_semi")

    def merge(self, links: DataFrame) -> None:
        if self.labels is not None:
            links = links.unionByName(self.labels.select(F.col("class").alias("a"), F.col("label").alias("b")))
        self.labels = component_labels(links).withColumnRenamed("node", "class")

    def meet_leaders(self, entries: DataFrame, turn: int) -> None:
        """Test each class against one leader, the first of all its buckets' leaders."""
        order = F.struct(F.xxhash64("class", F.lit(turn)).alias("o"), "class", "label")
        leaders = entries.groupBy("bucket").agg(F.min(order).alias("first"))
        met = entries.join(leaders, "bucket").filter("label != first.label")
        pairs = met.groupBy("class").agg(F.min("first").alias("first")).select(
            F.col("class").alias("b"), F.col("first.class").alias("a")
        )
        for name in ("a", "b"):
            pairs = pairs.join(
                self.classes.select(
                    F.col("class").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("brief").alias(f"s_{name}")
                ),
                name,
            )
        near = (
            pairs.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.how.percent)
            .filter(_equal_bytes(F.col("s_a"), F.col("s_b")) >= self.how.least_equal)
            .select("a", "b")
        )
        for name in ("b", "a"):
            near = near.join(self.texts.select(F.col("class").alias(name), F.col("text").alias(f"text_{name}")), name)
        self.merge(near.select("a", "b", "text_a", "text_b").mapInArrow(_confirmed(self.how), "a binary, b binary"))

    def large_put_together(self, entries: DataFrame) -> DataFrame:
        """Buckets of more members than a block that have members in common, as one."""
        large = entries.groupBy("bucket").agg(F.count("*").alias("n"), F.min("class").alias("hub"))
        large = staged(large.filter(F.col("n") > self.how.block).select("bucket", "hub"))
        small = entries.join(large, "bucket", "left_anti").select("bucket", "class", "label", F.lit(False).alias("joint"))
        members = staged(entries.join(large, "bucket").select("class", "label", "hub").distinct())
        groups = component_labels(members.select(F.col("class").alias("a"), F.col("hub").alias("b")))
        groups = groups.select(F.col("node").alias("class"), F.col("label").alias("group"))
        members = members.select("class", "label").distinct().join(groups, "class", "left")
        bucket = F.xxhash64(F.coalesce("group", "class"))
        return small.unionByName(members.select(bucket.alias("bucket"), "class", "label", F.lit(True).alias("joint")))

    def meet_in_blocks(self, entries: DataFrame) -> None:
        """Test all that remains between components."""
        dealt = dealt_in_blocks(self.large_put_together(entries), self.how.block)
        dealt = regrouped(dealt.join(self.classes.drop("row_key", "least_id"), "class"))
        schema = "bucket long, bi int, bj int, block int, class binary, label binary"
        near = staged(dealt.mapInArrow(_plausible(self.how), schema))
        links = regrouped(near.join(self.texts, "class")).mapInArrow(_linked(self.how), "a binary, b binary")
        self.merge(links)

    def run(self) -> DataFrame:
        before = None
        for turn in range(self.how.turns):
            entries = staged(self.open_entries())
            sums = entries.groupBy("bucket").agg(F.count("*").alias("n"))
            sums = sums.agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("n")).alias("work")).first()
            rows, work = sums["rows"] or 0, sums["work"] or 0
            if turn and (work <= 4 * rows or rows > 0.8 * before):
                break
            before = rows
            self.meet_leaders(entries, turn)
        else:
            entries = staged(self.open_entries())
        self.meet_in_blocks(entries)
        return self.labels


def near_duplicates(docs: DataFrame, how: Sketching | None = None) -> DataFrame:
    """Components of documents whose shingle sets are similar.

    Needs ``doc_id`` and ``text``; other columns are ignored. Returns a row per input
    row: ``doc_id``, ``n_shingles``, ``component_id`` (the smallest doc_id reachable),
    ``kept`` (whether that is its own), ``component`` (a key, null where the text has
    no words) and ``text_key`` (see ``row_key``). A null or empty text has the empty set and is linked with nothing.
    Equal rows share all results. A null doc_id takes part but never is the
    component's id; a component of such rows alone has a null id and keeps none.
    """
    how = how or Sketching()
    rows = docs.select("doc_id", "text", row_key(docs, "text").alias("row_key"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row_key binary, n_shingles long, class binary, bands array<bigint>, brief binary"
    sketched = staged(rows.mapInArrow(_sketches(how), schema))

    one = staged(
        sketched.filter("class IS NOT NULL").groupBy("class").agg(
            F.min("n_shingles").alias("n_shingles"), F.min("row_key").alias("row_key"),
            F.min("doc_id").alias("least_id"), F.any_value("brief").alias("brief"), F.any_value("bands").alias("bands"),
        )
    )
    entries = one.select("class", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    entries = staged(entries.join(shared, "bucket", "left_semi"))
    classes = staged(one.join(entries.select("class").distinct(), "class", "left_semi"))
    texts = staged(
        rows.select("row_key", "text").join(classes.select("row_key", "class"), "row_key")
        .select("class", "text").dropDuplicates(["class"])
    )
    labels = _Linker(classes, entries, texts, how).run()

    named = one.select("class", "least_id").join(labels, "class", "left")
    named = named.withColumn("label", F.coalesce("label", "class"))
    least = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "label").select("class", F.col("label").alias("component"), "component_id")
    out = sketched.select("doc_id", "n_shingles", "class", F.col("row_key").alias("text_key")).join(named, "class", "left")
    component_id = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id", "n_shingles", component_id.alias("component_id"),
        F.coalesce(F.col("doc_id") == component_id, F.lit(False)).alias("kept"), "component", "text_key",
    )


def deduplicated(docs: DataFrame, how: Sketching | None = None) -> DataFrame:
    """One document of each component, with all its columns.

    It is the one with the smallest doc_id; a row without one stays only where its
    component has no other. Of repeated rows one stays, whichever other columns it has.
    Documents without words are linked with nothing and all stay.
    """
    found = near_duplicates(docs, how)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("k")
    keepers = staged(found.filter("component IS NOT NULL").groupBy("component").agg(first).select(
        F.col("k.doc_id").alias("__id"), F.col("k.text_key").alias("__key")
    ))
    keyed = docs.withColumn("__text_key", row_key(docs, "text"))
    fits = (keyed["__text_key"] == keepers["__key"]) & keyed["doc_id"].eqNullSafe(keepers["__id"])
    own = keyed.join(keepers, fits, "left_semi").dropDuplicates(["doc_id", "__text_key"])
    wordless = keyed.filter(~F.coalesce(F.col("text").rlike(SPACED_WORD), F.lit(False)))
    return own.unionByName(wordless).select(*docs.columns)
