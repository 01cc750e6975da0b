"""Chat formatting in Spark expressions only: turns to one training string with a loss mask, and back.

Turns are sorted within their conversation, where running sums of lengths give the spans of the mask;
then they are collected as structs. Adjacent turns of one role become one block
<s>[INST]role[/INST]text[TURN]text</s>.  Control strings inside roles or texts get a backslash
behind their first character (and one more for each that is there), which reading takes away again,
so texts that quote the template come back as they were.

Null texts and roles are empty; turns with the same number are ordered by role, then text; repeated
rows are turns of their own; a null conversation id is one conversation; an empty table gives no rows.
A conversation is one string, so it has to fit into one; its cost grows with its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, ROLE_END, TURN, CLOSE = "<s>[INST]", "[/INST]", "[TURN]", "</s>"
_INSIDE = r"(<|\[)(\\*)(s>|/s>|INST\]|/INST\]|TURN\])"
_ESCAPED = r"(<|\[)\\(\\*)(s>|/s>|INST\]|/INST\]|TURN\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _INSIDE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def format_chats(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss array<struct<start, length>>): the spans, in code points from 1, are the texts of role learn."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = rows.select(F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), told(role).alias("role"), told(text).alias("text"))
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = turns.select("*", F.row_number().over(in_order).alias("k"), F.lag("role").over(in_order).alias("before"), F.lead("role").over(in_order).alias("behind"))
    parts = turns.select(
        "conv_id",
        "turn",
        "role",
        "text",
        "k",
        F.when(F.col("before") == F.col("role"), F.lit(TURN)).otherwise(F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(ROLE_END))).alias("head"),
        escape(F.col("text")).alias("body"),
        F.when(F.col("behind") == F.col("role"), F.lit("")).otherwise(F.lit(CLOSE)).alias("tail"),
    )
    size = F.char_length("head") + F.char_length("body") + F.char_length("tail")
    so_far = F.sum(size).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.select("*", (so_far - F.char_length("tail") - F.char_length("body") + 1).cast("int").alias("start"), F.char_length("body").alias("length"))
    part = F.struct("k", F.concat("head", "body", "tail").alias("part"), (F.col("role") == learn).alias("learn"), "start", "length")
    got = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    spans = F.transform(F.filter("parts", lambda p: p["learn"]), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length")))
    return got.select("conv_id", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("formatted"), spans.alias("loss"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss_texts array<string>, formatted) from format_chats' rows."""
    blocks = F.filter(F.split("formatted", "</s>"), lambda b: b != "")
    split = F.transform(blocks, lambda b: F.split(F.substring(b, len(OPEN) + 1, 2**31 - 1), r"\[/INST\]"))
    turns = F.flatten(F.transform(split, lambda b: F.transform(F.split(b[1], r"\[TURN\]"), lambda t: F.struct(unescape(b[0]).alias("role"), unescape(t).alias("text")))))
    texts = F.transform("loss", lambda s: unescape(F.col("formatted").substr(s["start"], s["length"])))
    return formatted.select("conv_id", turns.alias("turns"), texts.alias("loss_texts"), "formatted")


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the formatted strings."""
    got = read_chats(formatted)
    return got.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length(F.array_join("loss_texts", "")).cast("long").alias("loss_chars"),
        F.sha2(F.array_join("loss_texts", ""), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
