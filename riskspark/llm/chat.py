"""Chat formatting with prefix-target expansion.

A turn is written as ``<|turn|>role<|text|>text<|end|>``. Inside role and text a backslash and the
opening of a control string are escaped with a backslash, so no text can form a control string and
the escape can be undone. Every assistant turn becomes an example: all turns before it are context
and only its text is trainable. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"


def escape(column):
    return F.replace(F.replace(column, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(column):
    return F.regexp_replace(column, r"(?s)\\(.)", "$1")


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): one row per conversation, its turns in order. NULL role or text: empty.

    Equal turn numbers are ordered by role, then text; a NULL turn comes first. Repeated rows stay.
    """
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def expand(convs: DataFrame) -> DataFrame:
    """One row per example: conv_id, example (from 0), last, formatted, loss_start, loss_chars (code points).

    An example ends with its target. If turns follow the last assistant turn, or there is none, a last
    example holds all turns and trains nothing (loss_chars 0), so the output always holds every turn.
    """
    parts = F.transform("turns", lambda t: F.struct(
        (t["role"] == "assistant").alias("target"), F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT)).alias("head"), escape(t["text"]).alias("body")))
    n = F.size("parts")
    ends = F.filter(F.transform("parts", lambda p, i: F.when(p["target"] | (i == n - 1), i + 1)), lambda x: x.isNotNull())
    rows = convs.select("conv_id", parts.alias("parts")).select("conv_id", "parts", F.posexplode(ends).alias("example", "upto"))
    goal = F.col("parts")[F.col("upto") - 1]
    before = F.array_join(F.transform(F.slice("parts", 1, F.col("upto") - 1), lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return rows.select("conv_id", "example", (F.col("upto") == n).alias("last"), F.concat(before, goal["head"]).alias("context"), goal.alias("goal")).select(
        "conv_id", "example", "last", F.concat("context", F.col("goal")["body"], F.lit(END)).alias("formatted"),
        F.length("context").alias("loss_start"), F.when(F.col("goal")["target"], F.length(F.col("goal")["body"])).otherwise(0).alias("loss_chars"))


def parse(formatted):
    """Turns (role, text) read back from a formatted string."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>"), lambda x: x != "")
    return F.transform(pieces, lambda x: F.struct(
        unescape(F.split(F.substring(x, len(TURN) + 1, 1 << 30), r"<\|text\|>")[0]).alias("role"), unescape(F.split(x, r"<\|text\|>")[1]).alias("text")))


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the examples alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    loss = unescape(F.col("formatted").substr(F.col("loss_start") + 1, F.col("loss_chars")))
    one = examples.select("conv_id", "example", F.when(F.col("last"), parse(F.col("formatted"))).alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("chars"))
    whole = one.groupBy("conv_id").agg(F.max_by("turns", "example").alias("turns"), F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"), F.sum("chars").alias("formatted_chars"))
    text = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                        F.length(text).cast("long").alias("loss_chars"), F.sha2(text, 256).alias("loss_sha256"), "formatted_chars")


def format_chat(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) to examples, see expand(). A NULL conv_id is a conversation of its own. An empty table gives no rows."""
    return expand(conversations_of(turns))
