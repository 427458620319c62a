"""Queries over the training-text tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylog.llm import oracles
from querylog.llm.chat import formatted_chats, read_back, under_mask
from querylog.llm.decontamination import benchmark_hits
from querylog.llm.importance import resampled
from querylog.llm.licences import scanned
from querylog.llm.main_text import extracted
from querylog.llm.merkle import folded, lowered_by_chance, manifest, proof_digest
from querylog.llm.mixing import mixed_rates
from querylog.llm.near_duplicates import Sketching, near_duplicates
from querylog.llm.nearest import nearest_neighbours
from querylog.llm.period_runs import longest_run, with_planted_periods, with_runs
from querylog.llm.rules import judged
from querylog.llm.shared import table
from querylog.llm.toxicity import scored
from querylog.llm.url_filter import filtered_urls

#: Shares of tokens that the mixture aims at, by domain.
TARGETS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}

#: The rules of the URL filter.
URL_RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as training text, and what is read back from it."""
    own = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    chats = formatted_chats(turns.unionByName(extra))
    back = chats.select(
        "conv_id", "formatted", read_back(F.col("formatted")).alias("turns"),
        under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in passages of a benchmark."""
    hits = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-equal documents, by word pairs at a similarity of 0.8."""
    found = near_duplicates(table(spark, sf_dir, "documents"), Sketching(shingle_words=2))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op5_mixing_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates that bring the languages of all documents to target shares of tokens."""
    docs = table(spark, sf_dir, "documents")
    known = labelled_domains(docs, table(spark, sf_dir, "labels"))
    found = mixed_rates(docs.select("doc_id", "text"), known, TARGETS)
    return found.select("doc_id", "tokens", "shares", "rate")


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The domain, here the language, of the good documents in the labelled table."""
    good = labels.filter("quality = 1").select("doc_id")
    return docs.select("doc_id", F.col("lang").alias("domain")).join(good, "doc_id", "left_semi")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards trusted text by importance."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resampled(docs, table(spark, sf_dir, "labels")).drop("text")


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence mentions of every document."""
    return scanned(table(spark, sf_dir, "documents")).drop("detections")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict of every page's URL."""
    pages = filtered_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return pages.select("page_id", "host", "path", "rule", "verdict")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts, likelihood ratio and verdict of every document."""
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, some of which are made to repeat."""
    docs = with_planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = with_runs(docs).withColumn("longest", longest_run(F.col("runs")))
    line = lambda r: F.concat_ws(",", *(r[n].cast("string") for n in ("start", "length", "period")))
    lines = F.transform("runs", lambda r: F.concat(line(r), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "longest.start", "longest.length", "longest.period",
        F.floor(F.col("longest.length") * 1000 / F.col("longest.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether a later text still fits them."""
    rows = manifest(table(spark, sf_dir, "documents"), presented={"text": lowered_by_chance()})
    rows = rows.withColumn("folded_root", folded(F.col("presented_leaf"), F.col("path")))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors to every hundredth one."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_neighbours(rows, rows.filter("vec_id % 100 = 0"))


QUERIES = {
    query.__name__: query
    for query in (
        op1_chat_formatting,
        op2_benchmark_decontamination,
        op3_html_extraction,
        op4_minhash_near_dedup,
        op5_mixing_to_targets,
        op6_quality_classifier,
        op7_licence_scan,
        op8_toxicity,
        op9_url_filter,
        op10_quality_rules,
        op11_periodic_runs,
        op12_merkle_manifest,
        op13_nearest_neighbours,
    )
}
ORACLES = {
    "op1_chat_formatting": oracles.CHATS,
    "op2_benchmark_decontamination": oracles.DECONTAMINATION,
    "op4_minhash_near_dedup": oracles.NEAR_DUPLICATES,
    "op9_url_filter": oracles.url_filter(URL_RULES),
    "op12_merkle_manifest": oracles.MERKLE,
}
