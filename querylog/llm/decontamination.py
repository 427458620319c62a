"""Finding benchmark passages in documents: a prefix-filtered set join.

An item is cut into windows of ``window`` words. A window's set are its shingles of
``shingle_words`` words (of all its words, if it has fewer), ordered by how rare they
are in the documents. As a window must be contained whole, its necessary prefix is
one shingle, the rarest; a window with a shingle that no document has is out at once.
Documents give their places of prefix shingles with the words around them. These are
joined with the offsets that the shingle has in windows, where offset and length must
lie inside the document (positional and length bounds), and the words found there
must be those of a window, compared as text.

Documents are read twice: to count shingles and to look for prefixes. A Bloom filter
of at most ``_MOST_BITS`` bits is all that goes to every task; it spares rows, while
the joins decide, so larger benchmarks stay right. Hot passages cost a row per place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylog.llm.shared import row_key, staged
from querylog.llm.textkit import plain_words, rolled, signed, word_hashes

_MOST_BITS = 1 << 26
_PROBES = (0, 19, 38)


def _windows(window: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item"), batch.column("text").cast(pa.binary()), strict=True):
                words = plain_words(text.as_py())
                size = min(window, len(words))
                if not size:
                    continue
                part = min(shingle, size)
                hashes = signed(rolled(word_hashes(words), part))
                starts = range(len(words) - size + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([item.as_py()] * len(starts), pa.string()),
                        pa.array([b" ".join(words[i : i + size]).decode() for i in starts], pa.string()),
                        pa.array([size] * len(starts), pa.int32()),
                        pa.array([part] * len(starts), pa.int32()),
                        pa.array([hashes[i : i + size - part + 1] for i in starts], pa.list_(pa.int64())),
                    ],
                    names=["item", "words", "size", "part", "shingles"],
                )

    return run


def _bloom(shingles: DataFrame) -> tuple[bytes, int]:
    """A Bloom filter of the column ``shingle``, put together by Spark."""
    spread = shingles.agg(F.approx_count_distinct("shingle")).first()[0]
    bits = 1 << 16
    while bits < 32 * spread and bits < _MOST_BITS:
        bits *= 2
    places = F.array(*(F.shiftrightunsigned("shingle", n).bitwiseAND(bits - 1) for n in _PROBES))
    cells = (
        shingles.select(F.explode(places).alias("p"))
        .groupBy(F.shiftright("p", 3).alias("cell"))
        .agg(F.bit_or(F.expr("shiftleft(1, cast(p & 7 as int))")).alias("mark"))
        .toArrow()
    )
    out = np.zeros(bits // 8, np.uint8)
    out[cells.column("cell").to_numpy()] = cells.column("mark").to_numpy()
    return out.tobytes(), bits


def _passing(hashes: np.ndarray, marks: np.ndarray, bits: int) -> np.ndarray:
    ok = np.ones(len(hashes), bool)
    for n in _PROBES:
        place = (hashes >> np.uint64(n)) & np.uint64(bits - 1)
        ok &= (marks[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
    return ok


def _counted(bloom, bits: int, parts: list[int]):
    """Places of the benchmark's shingles per shingle, summed over a batch of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(bloom.value, np.uint8)
        for batch in batches:
            found = [np.empty(0, np.uint64)]
            for text in batch.column("text").cast(pa.binary()):
                hashes = word_hashes(plain_words(text.as_py()))
                for part in parts:
                    shingles = rolled(hashes, part)
                    found.append(shingles[_passing(shingles, marks, bits)])
            shingles, count = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(shingles)), pa.array(count.astype(np.int64))], names=["shingle", "n"]
            )

    return run


_SPOT = pa.struct([("shingle", pa.int64()), ("at", pa.int32()), ("before", pa.int32()), ("around", pa.string())])


def _spotted(bloom, bits: int, parts: list[int], window: int, shingle: int):
    """Words per document, and where it has prefix shingles, with the words around."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(bloom.value, np.uint8)
        for batch in batches:
            sizes, spots = [], []
            for text in batch.column("text").cast(pa.binary()):
                words = plain_words(text.as_py())
                hashes, own = word_hashes(words), []
                for part in parts:
                    shingles = rolled(hashes, part)
                    reach = window if part == shingle else part
                    for at in np.flatnonzero(_passing(shingles, marks, bits)).tolist():
                        low = max(0, at - (reach - part))
                        around = b" ".join(words[low : at + reach]).decode()
                        own.append({"shingle": int(signed(shingles[at : at + 1])[0]), "at": at, "before": at - low, "around": around})
                sizes.append(len(words))
                spots.append(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("doc"), pa.array(sizes, pa.int64()), pa.array(spots, pa.list_(_SPOT))],
                names=["doc_id", "doc", "n_words", "spots"],
            )

    return run


def benchmark_hits(docs: DataFrame, items: DataFrame, window: int = 10, shingle_words: int = 5) -> DataFrame:
    """Overlap of each document with a benchmark.

    ``docs`` needs doc_id and text, ``items`` item_id and text; other columns are
    ignored. Returns a row per document: ``doc_id``, ``doc`` (a key of doc_id and text,
    see ``row_key``), ``n_words``, ``n_hit`` words inside windows of items, and
    ``item_ids``, sorted as strings. Null and empty texts have no words and no
    windows; an item without an id is named ``null``; equal items count once.
    """
    spark = docs.sparkSession
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    windows = staged(
        named.mapInArrow(
            _windows(window, shingle_words), "item string, words string, size int, part int, shingles array<bigint>"
        )
    )
    texts = windows.select("words", "size", "part", "shingles").dropDuplicates(["words"])
    places = staged(texts.select("words", "size", "part", F.posexplode("shingles").alias("offset", "shingle")))
    parts = sorted(r["part"] for r in places.select("part").distinct().collect())
    rows = docs.select("doc_id", row_key(docs, "doc_id", "text").alias("doc"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    marks, bits = _bloom(places)
    counts = rows.select("text").mapInArrow(
        _counted(spark.sparkContext.broadcast(marks), bits, parts), "shingle long, n long"
    )
    counts = counts.groupBy("shingle").agg(F.sum("n").alias("n"))
    rarest = places.join(counts, "shingle", "left").groupBy("words").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("first"),
        F.min("size").alias("size"),
    )
    prefix = staged(
        rarest.filter("first.n > 0").select("words", "size", F.col("first.shingle").alias("shingle"), F.col("first.offset").alias("offset"))
    )

    marks, bits = _bloom(prefix)
    spotted = staged(
        rows.mapInArrow(
            _spotted(spark.sparkContext.broadcast(marks), bits, parts, window, shingle_words),
            f"doc_id {kind}, doc binary, n_words long, spots array<struct<shingle:long,at:int,before:int,around:string>>",
        )
    )
    found = spotted.filter(F.size("spots") > 0).select("doc", F.explode("spots").alias("spot")).select("doc", "spot.*")
    offsets = prefix.select("shingle", "offset", "size").distinct()
    met = found.join(offsets, "shingle").filter("offset <= before")
    around = F.split("around", " ")
    met = met.filter(F.size(around) >= F.col("before") - F.col("offset") + F.col("size")).select(
        "doc", (F.col("at") - F.col("offset")).alias("start"), (F.col("at") - F.col("offset") + F.col("size")).alias("stop"),
        F.array_join(F.slice(around, F.col("before") - F.col("offset") + 1, F.col("size")), " ").alias("words"),
    )
    hits = staged(met.join(prefix.select("words"), "words", "left_semi").distinct())

    spans = F.array_sort(F.collect_set(F.struct("start", "stop")))
    step = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))

    def onward(state, span):
        fresh = F.greatest(F.lit(0), span["stop"] - F.greatest(span["start"], state["reach"]))
        return F.struct((state["n"] + fresh).alias("n"), F.greatest(state["reach"], span["stop"]).alias("reach"))

    covered = hits.groupBy("doc").agg(spans.alias("spans")).select(
        "doc", F.aggregate("spans", step, onward, lambda s: s["n"]).cast("long").alias("n_hit")
    )
    who = (
        hits.select("doc", "words").distinct().join(windows.select("words", "item").distinct(), "words")
        .groupBy("doc").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    )
    return spotted.drop("spots").join(covered.join(who, "doc"), "doc", "left").select(
        "doc_id", "doc", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The documents that hold no window of any item, with all their columns."""
    hit = benchmark_hits(docs, items, window).filter("n_hit > 0").select(F.col("doc").alias("__hit")).distinct()
    keyed = docs.withColumn("__doc", row_key(docs, "doc_id", "text"))
    return keyed.join(hit, keyed["__doc"] == hit["__hit"], "left_anti").select(*docs.columns)
