"""Prefix-target expansion of conversations.

Every assistant turn becomes its own example: all preceding turns as context, and only that reply trainable.
Turns after the last reply have no example of their own; they come in one more row with nothing trainable, so
that no turn is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>"


def guard(text: Column) -> Column:
    """One backslash more between ``<`` and ``|``, so that a text holds no control string."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unguard(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def one_line(role: Column) -> Column:
    """A role without line feeds: backslashes doubled, line feeds written as backslash n."""
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def any_lines(role: Column) -> Column:
    parts = F.split(role, r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, target (index of the trainable turn, null in the rest row), n_turns (of the conversation),
    text, loss_start, loss_chars (code points of ``text``), last (holds all turns).

    ``conversations``: conv_id, turn, role, text; other columns are ignored.  Turns are ordered by turn, role
    and text, null turns first; repeated turns stay.  Null role and text are empty; rows with a null conv_id
    form a conversation.  Empty input gives no rows.  A conversation is gathered in one row, as its longest
    example must be anyway.
    """
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        F.coalesce("turn", F.lit(-(2**63))).alias("turn"), "role", "text"))).alias("t"))
    head = lambda t: F.concat(F.lit(START), guard(one_line(t["role"])), F.lit("\n"))
    cut = turns.select(
        "conv_id", F.size("t").alias("n_turns"),
        F.transform("t", lambda t: F.struct(
            (t["role"] == "assistant").alias("target"), F.char_length(head(t)).alias("head"),
            F.char_length(guard(t["text"])).alias("body"),
            F.concat(head(t), guard(t["text"]), F.lit(END + "\n")).alias("text"))).alias("t"),
    )
    picked = F.filter(
        F.sequence(F.lit(1), F.col("n_turns")),
        lambda k: F.element_at("t", k)["target"] | (k == F.col("n_turns")),
    )
    spread = cut.select("conv_id", "n_turns", "t", F.explode(picked).alias("k"))
    own = F.element_at("t", F.col("k"))
    text = F.array_join(F.slice(F.col("t.text"), F.lit(1), F.col("k")), "")
    before = F.char_length(text) - own["body"] - F.lit(len(END) + 1)
    return spread.select(
        "conv_id", F.when(own["target"], F.col("k") - 1).alias("target"), "n_turns", text.alias("text"),
        F.when(own["target"], before).otherwise(F.char_length(text)).alias("loss_start"),
        F.when(own["target"], own["body"]).otherwise(F.lit(0)).alias("loss_chars"),
        (F.col("k") == F.col("n_turns")).alias("last"),
    )


def read_turns(text: Column) -> Column:
    """Turns of a formatted text, as (role, text) in order."""
    parts = F.split(text, r"<\|im_end\|>\n")
    whole = F.slice(parts, F.lit(1), F.size(parts) - 1)
    body = lambda p: F.substring(p, F.lit(len(START) + 1), F.char_length(p))
    return F.transform(whole, lambda p: F.struct(
        any_lines(unguard(F.substring_index(body(p), "\n", 1))).alias("role"),
        unguard(F.substring(body(p), F.locate("\n", body(p)) + 1, F.char_length(p))).alias("text")))


def loss_text(row_text: str = "text") -> Column:
    return unguard(F.substring(F.col(row_text), F.col("loss_start") + 1, F.col("loss_chars")))


def chat_digests(conversations: DataFrame) -> DataFrame:
    """What formatted examples hold, read back from their texts: one row per conversation."""
    read = examples(conversations).select(
        "conv_id", "target", loss_text().alias("loss"), F.char_length("text").alias("chars"),
        F.when(F.col("last"), read_turns(F.col("text"))).alias("turns"),
    )
    joined = read.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("target", "loss")))).alias("losses"),
        F.first("turns", ignorenulls=True).alias("turns"), F.sum("chars").alias("formatted_chars"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.col("losses.loss"), "")
    return joined.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )
