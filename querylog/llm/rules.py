"""Quality rules with Spark expressions only.

Each document gets counts of words, symbols, repeated lines and words in repeated
three-word windows, and a likelihood ratio: words and neighbouring pairs are hashed
into ``buckets``, and the log ratio of two multinomials over them, trusted texts and
the whole raw corpus, is averaged over the document. A fixed ``least`` ratio decides.

Windows are compared by 64-bit hashes of their words within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylog.llm.shared import SPACED_WORD, let, trusted_rows

BUCKETS = 1 << 14
PRIOR = 60.0
LEAST = -0.02


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SPACED_WORD), F.lit(0))


def _hashes(text: Column) -> Column:
    return F.transform(_words(text), lambda w: F.xxhash64(w))


def _grams(hashes: Column, buckets: int) -> Column:
    """Buckets of all words and of all pairs of neighbours."""
    return F.concat(
        F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int")),
        F.filter(
            F.transform(hashes, lambda h, i: F.pmod(F.xxhash64(h, F.get(hashes, i + 1)), F.lit(buckets)).cast("int")),
            lambda g, i: i < F.size(hashes) - 1,
        ),
    )


def _repeated(hashes: Column) -> Column:
    """Words inside three-word windows that the text has more than once."""
    places = F.sequence(F.lit(0), F.size(hashes) - 3)
    windows = F.transform(
        places,
        lambda i: F.struct(F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)).alias("h"), i.alias("i")),
    )

    def covered(ordered: Column) -> Column:
        twice = F.filter(
            ordered,
            lambda w, k: (F.get(ordered, k - 1)["h"] == w["h"]) | (F.get(ordered, k + 1)["h"] == w["h"]),
        )
        words = F.flatten(F.transform(twice, lambda w: F.array(w["i"], w["i"] + 1, w["i"] + 2)))
        return F.size(F.array_distinct(words))

    def count(all_: Column) -> Column:
        single = F.size(F.array_distinct(F.transform(all_, lambda w: w["h"]))) == F.size(all_)
        return F.when(single, 0).otherwise(let(F.sort_array(all_), covered))

    return F.when(F.size(hashes) < 3, 0).otherwise(let(windows, count))


def gram_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """How often the texts have each bucket; summed map-side, so ``buckets`` rows a task."""
    grams = let(_hashes(F.coalesce("text", F.lit(""))), lambda h: _grams(h, buckets))
    return texts.select(F.explode(grams).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def ratio_vector(target: DataFrame, raw: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row with one array: the log ratio of every bucket.

    Its length is fixed, however large the corpus, so it may pass through the driver.
    """
    spark = raw.sparkSession
    both = (
        spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
        .join(raw.withColumnRenamed("n", "r"), "bucket", "left")
        .join(target.withColumnRenamed("n", "t"), "bucket", "left")
    )
    one = both.agg(F.sort_array(F.collect_list(F.struct("bucket", F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("r", F.lit(0)).alias("r")))).alias("all"))
    one = one.select(
        "all",
        F.aggregate("all", F.lit(0).cast("long"), lambda s, x: s + x["t"]).alias("st"),
        F.aggregate("all", F.lit(0).cast("long"), lambda s, x: s + x["r"]).alias("sr"),
    )
    weight = F.lit(PRIOR * buckets)

    def ratio(x: Column) -> Column:
        share = (x["r"] + 1.0) / (F.col("sr") + buckets)
        return F.log((x["t"] + weight * share) / (F.col("st") + weight)) - F.log(share)

    flat = F.transform("all", lambda x: F.lit(0.0))
    return one.select(F.when(F.col("st") > 0, F.transform("all", ratio)).otherwise(flat).alias("ratios"))


def judged(docs: DataFrame, labels: DataFrame, least: float = LEAST, buckets: int = BUCKETS) -> DataFrame:
    """Counts and verdict of every document.

    Needs doc_id and text in ``docs``, doc_id and quality in ``labels``; other columns
    are ignored. Returns ``doc_id``, ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_dup_lines``, ``n_repeat_words``, ``base_failed``, ``kept`` and ``log_ratio``
    (0 for a text without words). A null text is an empty one. Without trusted rows
    all ratios are 0. Equal rows get equal results.
    """
    raw = gram_counts(docs.select("text"), buckets)
    target = gram_counts(trusted_rows(docs.select("doc_id", "text"), labels), buckets)
    values = ratio_vector(target, raw, buckets).first()["ratios"]
    ratios = F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")  # folded to a constant

    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(SPACED_WORD))

    def figures(hashes: Column) -> Column:
        grams = _grams(hashes, buckets)
        total = F.aggregate(grams, F.lit(0.0), lambda s, g: s + F.get(ratios, g))
        return F.struct(
            F.size(hashes).cast("long").alias("n_words"),
            _repeated(hashes).cast("long").alias("n_repeat_words"),
            F.when(F.size(hashes) > 0, total / (2 * F.size(hashes) - 1)).otherwise(0.0).alias("log_ratio"),
        )

    out = docs.select(
        "doc_id",
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda all_: F.size(all_) - F.size(F.array_distinct(all_))).cast("long").alias("n_dup_lines"),
        let(_hashes(text), figures).alias("f"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        out.select("doc_id", "f.n_words", "word_chars", "n_symbols", "n_dup_lines", "f.n_repeat_words", "f.log_ratio")
        .withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("log_ratio") >= least))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ratio")
    )
