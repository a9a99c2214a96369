"""Operator 8, chat formatting by prefix-target expansion (DataFrame only).

Every assistant turn becomes an example of its own: all turns before it are
context, its text alone is trainable. Turns after the last assistant turn form
one more example without a target, so nothing of a conversation is lost.

A turn is written ``<s>[ROLE]role[TEXT]text</s>``. In roles and texts ``~``,
``<`` and ``[`` are written ``~0``, ``~1`` and ``~2``, so no control string can
stand in them, and reading replaces ``~1``, ``~2`` and then ``~0``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLE, TEXT, END = "<s>[ROLE]", "[TEXT]", "</s>"
#: fixed order: the escape character first when writing, last when reading
ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"))


def escape(c: Column) -> Column:
    for a, b in ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    for a, b in reversed(ESCAPES):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant") -> DataFrame:
    """conv_id, example (from 0), n_turns (of the example), formatted,
    loss_start and loss_length (code points of the trainable text; length 0
    in an example without a target), is_last.

    Rows are ordered by turn, equal turns by role and text, null turns first;
    null roles and texts are empty; rows with a null conversation form one;
    rows that repeat stay. Other columns are not read."""
    empty = F.lit("")
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), empty).alias("role"),
        F.coalesce(F.col(text).cast("string"), empty).alias("text"),
    )
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    chats = chats.select(
        "conv_id",
        F.transform("t", lambda x: F.concat(F.lit(ROLE), escape(x["role"]), F.lit(TEXT), escape(x["text"]), F.lit(END))).alias("written"),
        F.transform("t", lambda x: F.when(x["role"] == target, F.length(escape(x["text"]))).otherwise(F.lit(-1))).alias("loss"),
    )
    # where examples end: at each target, and at the last turn
    last = F.size("written") - 1
    stops = F.filter(F.sequence(F.lit(0), last), lambda i: (F.get("loss", i) >= 0) | (i == last))
    one = chats.select("conv_id", "written", "loss", F.size(stops).alias("n"), F.posexplode(stops).alias("example", "stop"))
    return one.select(
        "conv_id",
        "example",
        (F.col("stop") + 1).alias("n_turns"),
        F.array_join(F.slice("written", F.lit(1), F.col("stop") + 1), "").alias("formatted"),
        F.greatest(F.get("loss", F.col("stop")), F.lit(0)).alias("loss_length"),
        (F.get("loss", F.col("stop")) >= 0).alias("has_target"),
        (F.col("example") == F.col("n") - 1).alias("is_last"),
    ).withColumn("loss_start", F.length("formatted") - len(END) - F.col("loss_length"))


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the formatted strings and their spans alone:
    n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    turns = F.filter(F.split("formatted", END), lambda x: x != "")
    body = F.transform(turns, lambda x: F.substring(x, len(ROLE) + 1, 1 << 30))

    def said(x: Column) -> Column:
        who = F.substring_index(x, TEXT, 1)
        what = F.substring(x, F.length(who) + len(TEXT) + 1, F.lit(1 << 30))
        return F.concat(unescape(who), F.lit("\n"), unescape(what), F.lit("\n"))

    loss = unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_length")))
    one = examples.select(
        "conv_id",
        "example",
        F.length("formatted").cast("long").alias("chars"),
        F.when(F.col("has_target"), loss).alias("loss"),
        F.when(F.col("is_last"), F.size(turns).cast("long")).alias("n_turns"),
        F.when(F.col("is_last"), F.sha2(F.array_join(F.transform(body, said), ""), 256)).alias("turns_sha256"),
    )
    whole = one.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", F.coalesce("loss", F.lit("")).alias("loss")))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return whole.select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"
    )
