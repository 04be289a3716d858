"""Conversations as one training text each, with the spans that a loss counts.

Everything is Spark expressions. Turns are collected as structs in blocks of
turn numbers, sorted, and neighbours of one role are merged by an aggregation
over the array; blocks are then put together in order. So a conversation of very
many turns is sorted and joined in many small pieces, and only its short list of
blocks meets in one place.

The template, turn by turn: a head by role, the texts of the turns that were
merged with a mark between them, a tail. Inside a text every control string
gets one more backslash after its first character than it had, so none is left
as it is, and taking one away gives the text back::

    [SYS]text[/SYS][INST]text[TURN]text[/INST]<s>text</s>[ROLE]name[/ROLE]text[/TEXT]
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions.text import let

#: Turns whose numbers share all but the last 8 bits are joined together first.
BLOCK_BITS = 8

HEADS = {"user": "[INST]", "assistant": "<s>", "system": "[SYS]"}
TAILS = {"user": "[/INST]", "assistant": "</s>", "system": "[/SYS]"}
OTHER_HEAD, OTHER_HEAD_END, OTHER_TAIL, BETWEEN = "[ROLE]", "[/ROLE]", "[/TEXT]", "[TURN]"
#: What the model is to learn to say.
LEARNT = "assistant"

# a control string, with any number of backslashes after its first character
_NAMES = r"(/?(?:s>|INST\]|SYS\]|ROLE\]|TEXT\]|TURN\]))"
_CONTROL, _ESCAPED = r"([<\[])(\\*)" + _NAMES, r"([<\[])\\(\\*)" + _NAMES
_TAIL = r"\[/INST\]|</s>|\[/SYS\]|\[/TEXT\]"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def head(role: Column) -> Column:
    known = F.lit(None).cast("string")
    for name, mark in HEADS.items():
        known = F.when(role == name, mark).otherwise(known)
    return F.coalesce(known, F.concat(F.lit(OTHER_HEAD), escaped(role), F.lit(OTHER_HEAD_END)))


def tail(role: Column) -> Column:
    out = F.lit(OTHER_TAIL)
    for name, mark in TAILS.items():
        out = F.when(role == name, mark).otherwise(out)
    return out


def _merged(turns: Column) -> Column:
    """Neighbouring turns of one role: [(role, first turn, number of turns)], from an array in order."""
    empty = F.array().cast("array<struct<role:string,at:int,n:int>>")

    def part(role: Column, at: Column, n: Column) -> Column:
        return F.array(F.struct(role.alias("role"), at.alias("at"), n.alias("n")))

    def step(acc: Column, last: Column, role: Column) -> Column:
        longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), part(role, last["at"], last["n"] + 1))
        opened = F.concat(acc, part(role, F.coalesce(last["at"] + last["n"], F.lit(1)), F.lit(1)))
        return F.when(last["role"] == role, longer).otherwise(opened)

    return F.aggregate(
        turns,
        empty,
        lambda acc, turn: let(F.try_element_at(acc, F.lit(-1)), lambda last: step(acc, last, turn["role"])),
    )


def _spans(pieces: Column) -> Column:
    """Where the pieces that are learnt lie, from [(text, learnt)] that follow each other."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.char_length(piece["text"])
        span = F.array(F.struct(acc["at"].alias("start"), end.alias("end")))
        return F.struct(
            end.alias("at"), F.when(piece["learnt"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans")
        )

    return F.aggregate(pieces, start, step, lambda acc: acc["spans"])


def _pieces(merged: Column, turns: Column) -> Column:
    """[(text, learnt)] of a block: texts with the marks between them. The head of the
    first and the tail of the last turn depend on the neighbouring blocks and are left out."""

    def of(part: Column, i: Column) -> Column:
        lead = F.when(i == 0, F.lit("")).otherwise(
            F.concat(tail(F.get(merged, i - 1)["role"]), head(part["role"]))
        )
        return F.transform(
            F.slice(turns, part["at"], part["n"]),
            lambda turn, j: F.array(
                F.struct(F.when(j == 0, lead).otherwise(F.lit(BETWEEN)).alias("text"), F.lit(False).alias("learnt")),
                F.struct(turn["text"].alias("text"), (part["role"] == LEARNT).alias("learnt")),
            ),
        )

    return F.flatten(F.flatten(F.transform(merged, of)))


def formatted(
    turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: ``key``, n_turns, formatted, loss_spans.

    ``formatted`` is the template's text and loss_spans the places (start and
    end in characters, in order) of every text that the assistant says.

    Turns are sorted by number, nulls first, and ties by role and text, so rows
    that repeat stay, next to each other. Null texts and null roles are empty
    ones; a role that the template doesn't know is written out. Rows without a
    key are one conversation. An empty table gives no rows. Other columns are not
    looked at. A conversation is one value of the result, so it has to fit in one.
    """
    number = F.coalesce(F.col(turn).cast("bigint"), F.lit(-(1 << 63)))
    rows = turns.select(
        F.col(key).alias("key"),
        F.shiftright(number, BLOCK_BITS).alias("block"),
        F.struct(
            number.alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("row"),
    )
    # raw texts are collected and sorted: escaping could change the order of ties
    blocks = rows.groupBy("key", "block").agg(F.sort_array(F.collect_list("row")).alias("sorted"))
    blocks = blocks.select(
        "key",
        "block",
        F.transform(
            "sorted", lambda r: F.struct(r["role"].alias("role"), escaped(r["text"]).alias("text"))
        ).alias("turns"),
    )
    body = let(F.col("turns"), lambda t: let(_merged(t), lambda m: _pieces(m, t)))
    blocks = blocks.select(
        "key",
        F.struct(
            "block",
            F.element_at("turns", 1)["role"].alias("first"),
            F.element_at("turns", -1)["role"].alias("last"),
            F.size("turns").cast("bigint").alias("n"),
            let(
                body,
                lambda p: F.struct(
                    F.array_join(F.transform(p, lambda x: x["text"]), "").alias("text"), _spans(p).alias("spans")
                ),
            ).alias("body"),
        ).alias("part"),
    )
    whole = blocks.groupBy("key").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return whole.select(F.col("key").alias(key), let(F.col("parts"), _joined).alias("out")).select(key, "out.*")


def _joined(parts: Column) -> Column:
    """Blocks in order, each led by what closes the one before and opens it."""

    def lead(part: Column, i: Column) -> Column:
        before = F.get(parts, i - 1)["last"]
        opened = F.when(i == 0, head(part["first"])).otherwise(F.concat(tail(before), head(part["first"])))
        return F.when((i > 0) & (before == part["first"]), F.lit(BETWEEN)).otherwise(opened)

    def shifted(spans: Column, by: Column) -> Column:
        return F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end")))

    def result(leads: Column) -> Column:
        lengths = F.transform(
            parts, lambda p, i: F.char_length(F.get(leads, i)) + F.char_length(p["body"]["text"])
        )
        starts = F.aggregate(
            lengths,
            F.array(F.lit(0).cast("bigint")),
            lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)),
        )
        texts = F.flatten(F.transform(parts, lambda p, i: F.array(F.get(leads, i), p["body"]["text"])))
        end = F.array(tail(F.element_at(parts, -1)["last"]))
        spans = let(
            starts,
            lambda at: F.flatten(
                F.transform(
                    parts, lambda p, i: shifted(p["body"]["spans"], F.get(at, i) + F.char_length(F.get(leads, i)))
                )
            ),
        )
        return F.struct(
            F.aggregate(parts, F.lit(0).cast("bigint"), lambda n, p: n + p["n"]).alias("n_turns"),
            F.array_join(F.concat(texts, end), "").alias("formatted"),
            spans.alias("loss_spans"),
        )

    return let(F.transform(parts, lead), result)


def read_turns(text: Column) -> Column:
    """[(role, text)] of all turns, as they were before merging and escaping."""

    def of(part: Column) -> Column:
        cases = None
        for name, mark in HEADS.items():
            found = F.struct(F.lit(name).alias("role"), F.substr(part, F.lit(len(mark) + 1)).alias("body"))
            cases = F.when(F.startswith(part, F.lit(mark)), found) if cases is None else cases.when(
                F.startswith(part, F.lit(mark)), found
            )
        named = F.substr(part, F.lit(len(OTHER_HEAD) + 1))
        other = F.struct(
            unescaped(F.substring_index(named, OTHER_HEAD_END, 1)).alias("role"),
            F.substr(named, F.locate(OTHER_HEAD_END, named) + len(OTHER_HEAD_END)).alias("body"),
        )
        return let(
            cases.otherwise(other),
            lambda turn: F.transform(
                F.split(turn["body"], r"\[TURN\]"),
                lambda t: F.struct(turn["role"].alias("role"), unescaped(t).alias("text")),
            ),
        )

    parts = F.split(text, _TAIL)  # the last one is what follows the last tail: nothing
    return F.flatten(F.transform(F.slice(parts, 1, F.size(parts) - 1), of))


def read_spans(text: Column, spans: Column) -> Column:
    """The unescaped texts of spans in order. A long text is first cut into stretches of
    about as many spans as there are stretches, since places are counted from the start."""

    def cut(source: Column, base: Column, some: Column) -> Column:
        return F.transform(
            some,
            lambda s: unescaped(F.substr(source, (s["start"] - base + 1).cast("int"), (s["end"] - s["start"]).cast("int"))),
        )

    def stretch(some: Column) -> Column:
        base, end = F.element_at(some, 1)["start"], F.element_at(some, -1)["end"]
        return let(
            F.substr(text, (base + 1).cast("int"), (end - base).cast("int")), lambda part: cut(part, base, some)
        )

    step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(spans))).cast("int"))
    stretches = F.transform(
        F.when(F.size(spans) > 0, F.sequence(F.lit(1), F.size(spans), step)).otherwise(F.array().cast("array<int>")),
        lambda at: stretch(F.slice(spans, at, step)),
    )
    return F.flatten(stretches)
