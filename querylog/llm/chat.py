"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted. Neighbours of one role
become one block: ``[INST]…[/INST]`` for the user, ``<<SYS>>…<</SYS>>`` for the
system, ``[ANSWER]…</s>`` for the assistant, ``[ROLE]name[/ROLE]…</s>`` for others;
``[TURN]`` stands between the turns of a block, ``<s>`` before the first one. Texts
are escaped: a control string gets a backslash behind its bracket, one that has
backslashes there gets one more, so that reading takes just one away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylog.llm.shared import let

#: What follows the first bracket of a control string.
_REST = r"(?:/?s>|</?SYS>>|/?INST\]|ANSWER\]|/?ROLE\]|TURN\])"
_OPEN = r"\[INST\]|<<SYS>>|\[ANSWER\]|\[ROLE\]"
_BLOCK = r"(?s)^(?:\[INST\]|<<SYS>>|\[ANSWER\]|\[ROLE\](.*?)\[/ROLE\])(.*)(?:\[/INST\]|<</SYS>>|</s>)$"
_NEXT = "[TURN]"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)(?={_REST})", r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)(?={_REST})", r"$1$2")


def _opening(role: Column) -> Column:
    return (
        F.when(role == "user", "[INST]").when(role == "system", "<<SYS>>").when(role == "assistant", "[ANSWER]")
        .otherwise(F.concat(F.lit("[ROLE]"), escaped(role), F.lit("[/ROLE]")))
    )


def _closing(role: Column) -> Column:
    return F.when(role == "user", "[/INST]").when(role == "system", "<</SYS>>").otherwise("</s>")


def _blocks(turns: Column) -> Column:
    """Runs of turns of one role, in linear time: where runs start, then slices."""

    def cut(all_: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(all_))
        first = F.filter(places, lambda i: (i == 1) | (F.element_at(all_, i)["role"] != F.get(all_, i - 2)["role"]))

        def runs(starts: Column) -> Column:
            return F.transform(
                starts,
                lambda start, k: F.slice(all_, start, F.coalesce(F.get(starts, k + 1), F.size(all_) + 1) - start),
            )

        return let(first, runs)

    return let(turns, cut)


def _mask(blocks: Column) -> Column:
    """Start and stop of every assistant turn, counted in code points."""

    def block(state: Column, turns: Column) -> Column:
        role = turns[0]["role"]

        def turn(inner: Column, one: Column) -> Column:
            stop = inner["at"] + F.length(one["text"])
            span = F.array(F.struct(inner["at"].alias("start"), stop.alias("stop")))
            return F.struct(
                (stop + len(_NEXT)).alias("at"),
                F.when(role == "assistant", F.concat(inner["spans"], span)).otherwise(inner["spans"]).alias("spans"),
            )

        start = F.struct((state["at"] + F.length(_opening(role))).alias("at"), state["spans"].alias("spans"))
        return F.aggregate(
            turns, start, turn,
            lambda end: F.struct((end["at"] - len(_NEXT) + F.length(_closing(role))).alias("at"), end["spans"].alias("spans")),
        )

    zero = F.struct(F.lit(3).alias("at"), F.expr("cast(array() as array<struct<start:int,stop:int>>)").alias("spans"))
    return F.aggregate(blocks, zero, block, lambda end: end["spans"])


def formatted_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``loss_spans``.

    ``turns`` needs conv_id, turn, role and text; other columns are ignored. A null
    role or text is empty. Turns are ordered by turn (null first), role and text, so
    equal turns and repeated rows have a fixed order. Rows without a conv_id are one
    conversation. A conversation becomes one string, so it must fit a row; all else
    is linear in its length.
    """
    blank = F.lit("")
    turn = F.struct("turn", F.coalesce("role", blank).alias("role"), escaped(F.coalesce("text", blank)).alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    blocks = grouped.select("conv_id", _blocks(F.col("turns")).alias("blocks"))

    def render(block: Column) -> Column:
        role = block[0]["role"]
        return F.concat(_opening(role), F.array_join(F.transform(block, lambda t: t["text"]), _NEXT), _closing(role))

    text = F.concat(F.lit("<s>"), F.array_join(F.transform("blocks", render), ""))
    return blocks.select("conv_id", text.alias("formatted"), _mask(F.col("blocks")).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of role and text."""
    blocks = F.split(F.substring(formatted, 4, 2**31 - 1), f"(?={_OPEN})", -1)

    def read(block: Column) -> Column:
        role = (
            F.when(block.startswith("[INST]"), "user").when(block.startswith("<<SYS>>"), "system")
            .when(block.startswith("[ANSWER]"), "assistant").otherwise(unescaped(F.regexp_extract(block, _BLOCK, 1)))
        )
        texts = F.split(F.regexp_extract(block, _BLOCK, 2), r"\[TURN\]", -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(F.filter(blocks, lambda b: b != ""), read))


def under_mask(formatted: Column, spans: Column) -> Column:
    """The unescaped text of all spans, in order."""
    pieces = F.transform(spans, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["stop"] - s["start"])))
    return F.array_join(pieces, "")
