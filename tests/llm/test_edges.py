"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from querylog.llm.chat import formatted_chats, read_back, under_mask
from querylog.llm.decontamination import benchmark_hits, decontaminated
from querylog.llm.importance import resampled, resampled_only
from querylog.llm.licences import scanned
from querylog.llm.main_text import extracted
from querylog.llm.mixing import mixed_rates
from querylog.llm.near_duplicates import deduplicated, near_duplicates
from querylog.llm.rules import judged
from querylog.llm.toxicity import Network, not_toxic, scored
from querylog.llm.url_filter import filtered_urls

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(150_000))
PASSAGE = "one two three four five six seven eight nine ten eleven twelve"
TEXTS = [
    (1, None), (2, ""), (3, " \t\n "), (4, "word"), (5, "word"), (5, "word"), (None, "a b c"), (None, None),
    (6, LONG), (7, LONG + " more"), (8, f"so {PASSAGE} it goes"), (9, "!!! ???"), (10, "Grüße aus dem Süden, über alles"),
]
#: Names that operators use for their own columns.
CLASHING = ("row_key", "class", "bucket", "label", "kept", "score", "rate", "tokens", "__key", "log_weight", "doc", "n")
NETWORK = Network(epochs=1, buckets=1 << 12)


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string")})
    return rows.withColumns({name: F.lit(name) for name in CLASHING}).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(4, 1, 0), (8, 1, 1), (8, 1, 1), (10, 1, 0), (6, 0, 1), (7, 1, None), (None, 1, 1), (3, None, 0)],
        "doc_id long, quality int, toxic int",
    )


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (2, "word"), (3, None), (4, ""), (None, "c"), (7, "gone for good")], "item_id long, text string")


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def test_near_duplicates(docs, nothing):
    rows = near_duplicates(docs).collect()
    assert len(rows) == len(TEXTS)
    of = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert [of[i]["n_shingles"] for i in (1, 2, 3, 4, 9)] == [0, 0, 0, 1, 1]
    assert of[5]["component_id"] == 4 and not of[5]["kept"] and of[4]["kept"]
    assert of[7]["component_id"] == 6 and of[1]["component_id"] == 1 and of[1]["kept"]
    alone = [r for r in rows if r["doc_id"] is None and r["n_shingles"]]
    assert [(r["component_id"], r["kept"]) for r in alone] == [(None, False)]
    assert near_duplicates(nothing).collect() == []
    left = deduplicated(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left.filter("text rlike '[^ \\t\\n]'").collect()) == sorted(
        [(0, "a b c"), (4, "word"), (6, LONG), (8, TEXTS[10][1]), (9, "!!! ???"), (10, TEXTS[12][1])]
    )
    assert left.filter("NOT coalesce(text, '') rlike '[^ \\t\\n]'").count() == 4
    assert deduplicated(nothing).collect() == []


def test_decontamination(docs, items, nothing):
    rows = benchmark_hits(docs, items).collect()
    assert len(rows) == len(TEXTS)
    of = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert (of[8]["n_words"], of[8]["n_hit"], of[8]["item_ids"]) == (15, 12, ["1"])
    assert (of[4]["n_hit"], of[4]["item_ids"], of[5]["item_ids"]) == (1, ["2"], ["2"])
    assert (of[1]["n_words"], of[1]["n_hit"], of[1]["item_ids"]) == (0, 0, [])
    assert sorted(r["item_ids"] for r in rows if r["doc_id"] is None) == [[], ["null"]]
    left = decontaminated(docs, items)
    assert left.columns == docs.columns and left.count() == len(TEXTS) - 5
    assert decontaminated(nothing, items).collect() == []
    assert decontaminated(docs, items.limit(0)).count() == len(TEXTS)


def test_importance(docs, labels, nothing):
    rows = resampled(docs.drop("kept", "log_weight"), labels)
    assert rows.count() == len(TEXTS)
    assert {r["log_weight"] for r in rows.filter("text = '' OR text IS NULL").collect()} == {0.0}
    left = resampled_only(docs, labels)
    assert left.columns == docs.columns and {r["kept"] for r in left.collect()} <= {"kept"}
    assert resampled_only(nothing, labels).collect() == []
    assert {r["log_weight"] for r in resampled(docs, labels.limit(0)).collect()} == {0.0}


def test_toxicity(docs, labels, nothing):
    rows = scored(docs, labels, NETWORK).collect()
    assert len(rows) == len(TEXTS)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert not_toxic(docs, labels, NETWORK).columns == docs.columns
    assert not_toxic(nothing, labels).collect() == []
    assert {r["score"] for r in scored(docs, labels.limit(0)).collect()} == {0.0}


def test_mixing(docs, labels, nothing):
    known = docs.select("doc_id", F.col("lang").alias("domain"))
    rows = mixed_rates(docs, known, {"en": 1.0}).collect()
    assert len(rows) == len(TEXTS) and all(r["rate"] >= 0 for r in rows)
    assert {r["tokens"] for r in rows if not r["text"]} == {0}
    assert mixed_rates(nothing, known, {"en": 1.0}).collect() == []
    assert {r["rate"] for r in mixed_rates(docs, known.limit(0), {"en": 1.0}).collect()} == {1.0}
    assert {r["rate"] for r in mixed_rates(docs, known, {}).collect()} == {1.0}


def test_licences(spark, docs, nothing):
    assert scanned(docs).count() == len(TEXTS) and scanned(nothing).collect() == []
    long_ = "GNU General  Public-License, " * 3000 + " Apache License 2.0"
    rows = spark.createDataFrame([(1, None), (2, long_), (3, "Under the terms of the MIT license or the Mozilla Public License 2.0")], "doc_id long, text string")
    none, many, two = scanned(rows).orderBy("doc_id").collect()
    assert (none["n_words"], none["n_base"], none["first_word"], none["labels"], none["score"]) == (0, 0, None, "", 0.0)
    assert (many["n_base"], many["first_word"], many["last_word"]) == (3001, 1, 12_000)
    assert many["base_labels"] == "apache,gpl" and "apache-2.0" in many["labels"]
    assert two["labels"] == "mit,mpl-2.0" and two["base_labels"] == "mit"


def test_rules(docs, labels, nothing):
    rows = judged(docs, labels).collect()
    assert len(rows) == len(TEXTS)
    of = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert (of[1]["n_words"], of[1]["word_chars"], of[1]["base_failed"], of[1]["kept"]) == (0, 0, True, False)
    assert of[6]["n_words"] == 150_000 and of[6]["n_repeat_words"] == 150_000
    assert judged(nothing, labels).collect() == []
    assert {r["log_ratio"] for r in judged(docs, labels.limit(0)).collect()} == {0.0}


def test_chats(spark):
    odd = ["</s>[INST] ok [/INST]", "[\\INST] <\\\\s> \\", "<<SYS>>", None, "", "[TURN][ROLE]x[/ROLE]<", "ü\n𝄞"]
    rows = [(1, i, role, text) for i, (role, text) in enumerate((r, t) for t in odd for r in ("user", "user", "assistant", "assistant", "system", "tool</s>", None))]
    rows += [(None, None, None, None), (2, 0, "assistant", "same"), (2, 0, "assistant", "same")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("x"))
    chats = formatted_chats(turns)
    back = {
        r["conv_id"]: r
        for r in chats.select("conv_id", read_back(F.col("formatted")).alias("turns"), under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    }
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [(r[2] or "", r[3] or "") for r in rows if r[0] == 1]
    assert back[1]["loss"] == "".join(2 * (t or "") for t in odd)
    assert [tuple(t) for t in back[None]["turns"]] == [("", "")] and back[None]["loss"] == ""
    assert back[2]["loss"] == "samesame"
    assert formatted_chats(turns.limit(0)).collect() == []


def test_main_text(spark):
    pages = [
        (1, None), (2, ""), (3, "plain words &amp; more"), (4, "<p>unclosed <b>bold"), (5, "<!-- never closed"), (6, "<script>var a='<p>x</p>'"),
        (7, "<body><nav>Home</nav><div class='cookie-notice'>We use cookies</div><main><h1>On&nbsp;rivers</h1><p>One\n two<br>three</p>"
            "<aside>Related</aside><p>Four</p></main><section id=comments><p>The best of all the comments that I have read in the end</p></section>"
            "<form><p>Sign up</p></form><footer>&copy; us</footer></body>"),
        (8, "<p>" + "the man of the house is in the garden " * 20 + "</p><p>Short</p><p>end</p><ul><li><a href=x>One</a><li><a href=y>Two</a></ul>"),
        (9, "<div>" * 3000 + "deep" + "</div>" * 3000), (10, "a < b and <> c"),
    ]
    frame = spark.createDataFrame(pages, "page_id long, html string").withColumn("text", F.lit("old"))
    got = {r["page_id"]: r["text"] for r in extracted(frame).collect()}
    assert [got[i] for i in (1, 2, 5, 6)] == ["", "", "", ""]
    assert got[7] == "On rivers One two three Four"
    assert got[8].endswith("the garden Short")
    assert extracted(frame.limit(0)).collect() == []


def test_url_filter(spark):
    rules = [("org/", "allow"), ("example.org/es/", "block"), ("a.b/x", "block"), ("a.b/xy", "allow"), ("b/xyz/", "block")]
    urls = [None, "", "no scheme", "http://Example.ORG/es/1?q", "s://sub.example.org/es", "x://a.b/xyz/", "x://c.a.b/x#f", "x://org", "x://org/", "x://b/xyz/"]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("verdict", F.lit("old"))
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in filtered_urls(frame, rules).orderBy("page_id").collect()]
    assert got == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("example.org", "/es/1", "example.org/es/", "block"),
        ("sub.example.org", "/es", "org/", "allow"), ("a.b", "/xyz/", "a.b/xy", "allow"), ("c.a.b", "/x", "a.b/x", "block"),
        ("org", "", None, "allow"), ("org", "/", "org/", "allow"), ("b", "/xyz/", "b/xyz/", "block"),
    ]
    assert {r["verdict"] for r in filtered_urls(frame, []).collect()} == {"allow"}
    assert filtered_urls(frame.limit(0), rules).collect() == []
