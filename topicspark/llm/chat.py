"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted by (turn, role, text); neighbouring turns of one role
become one block. The template:

    <s>role<|says|>text<|next|>text</s><s>role<|says|>...</s>

Control strings inside roles and texts are escaped: the escape sign is doubled, and it is put behind the first
character of anything that a chat template could read as a mark (`<s>`, `</s>`, `<|`, `[INST]`, `[/INST]`). Taking the
sign away before every character brings the text back, so the format is reversible and a text cannot forge a turn.

The loss mask is a list of spans (start, length in characters, from 0) of the formatted text: the texts of the
assistant, without the marks around them.

Null texts and roles count as empty; a null turn comes first. Rows that repeat are turns of their own. Rows of a null
conv_id form a conversation. A conversation is one row of the result, so it has to fit a task; the spans and blocks are
made in one pass over its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks of the template
OPEN, SAYS, NEXT, CLOSE = "<s>", "<|says|>", "<|next|>", "</s>"
SIGN = "␛"
_MARK = r"<(?=/?s>|\|)|\[(?=/?INST\])"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    """The text without any control string, reversibly."""
    return F.regexp_replace(F.replace(text, F.lit(SIGN), F.lit(SIGN * 2)), _MARK, "$0" + SIGN)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, SIGN + r"([\s\S])", "$1")


def sorted_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as array<struct<turn, role, text>>."""
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def format_chats(turns: DataFrame, learned: str = LEARNED) -> DataFrame:
    """(conv_id, formatted, loss_mask) of every conversation of (conv_id, turn, role, text)."""
    chats = sorted_turns(turns)
    role = lambda i: F.get(F.col("turns"), i)["role"]

    def piece(x: Column, i: Column) -> Column:
        # what stands before the text depends on whether the turn before it has the same role
        block = F.concat(F.when(i > 0, F.lit(CLOSE)).otherwise(F.lit("")), F.lit(OPEN), escape(x["role"]), F.lit(SAYS))
        before = F.when((i > 0) & (role(i - 1) == x["role"]), F.lit(NEXT)).otherwise(block)
        return F.struct(before.alias("before"), escape(x["text"]).alias("text"), (x["role"] == learned).alias("learned"))

    chats = chats.select("conv_id", F.transform("turns", piece).alias("pieces"))
    formatted = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"])), ""), F.lit(CLOSE))
    sizes = F.transform(
        "pieces", lambda p: F.struct(F.length(p["before"]).cast("long").alias("skip"), F.length(p["text"]).cast("long").alias("size"), p["learned"].alias("learned"))
    )
    chats = chats.select("conv_id", formatted.alias("formatted"), sizes.alias("sizes"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: long, size: long>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["skip"]
        span = F.array(F.struct(begin.alias("start"), x["size"].alias("size")))
        return F.struct(
            (begin + x["size"]).alias("at"), F.when(x["learned"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans")
        )

    return chats.select("conv_id", "formatted", F.aggregate("sizes", start, step, lambda acc: acc["spans"]).alias("loss_mask"))


def read_chats(formatted: DataFrame, *more: str) -> DataFrame:
    """(conv_id, turns, learned): the turns as array<struct<role, text>> and the masked texts, read from the format alone.

    `more`: columns to hand on.
    """
    blocks = F.filter(F.split("formatted", CLOSE, -1), lambda b: b.startswith(OPEN))

    def turns_of(block: Column) -> Column:
        head = F.split(block, r"<\|says\|>", 2)
        role = unescape(F.substring(head[0], F.lit(len(OPEN) + 1), F.length(head[0])))
        return F.transform(F.split(head[1], r"<\|next\|>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    learned = F.transform(
        "loss_mask", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["size"].cast("int")))
    )
    return formatted.select("conv_id", *more, F.flatten(F.transform(blocks, turns_of)).alias("turns"), learned.alias("learned"))
