"""Chat formatting with Spark expressions only.

``format_conversations`` sorts the collected turn structs, merges adjacent turns of
one role into a block, and concatenates the blocks. Where each turn comes to lie is a running sum in the
same partitioning. ``read_conversations`` parses
the formatted text back, and cuts what the loss mask covers from its bytes. Both are built-in functions, linear in a conversation's turns; a
conversation is one output row, so only its own turns are ever gathered.

Cases: null text and null role count as empty; rows that tie on ``turn`` are ordered by
role, then text; repeated rows are repeated turns; rows with a null ``conv_id``
form one conversation of their own; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control strings. Escaped text has no "<", so none of them can occur inside a turn.
TURN, PART, END = "<|turn|>", "<|part|>", "<|end|>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    """Reversible: "&" and "<" become entities."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def _blocks(turns: Column) -> Column:
    """Adjacent turns of one role as struct(role, parts)."""
    at = F.sequence(F.lit(0), F.size(turns) - 1)
    begins = F.filter(at, lambda i: (i == 0) | (F.get(turns, i - 1)["role"] != F.get(turns, i)["role"]))
    bounds = F.arrays_zip(begins.alias("b"), F.concat(F.slice(begins, 2, F.size(begins)), F.array(F.size(turns))).alias("e"))
    return F.transform(
        bounds,
        lambda x: F.struct(
            F.get(turns, x["b"])["role"].alias("role"),
            F.transform(F.slice(turns, x["b"] + 1, x["e"] - x["b"]), lambda t: t["text"]).alias("parts"),
        ),
    )


def _placed(rows: DataFrame) -> DataFrame:
    """Turns with where their escaped text begins in the formatted conversation and how long it is, in characters and in bytes."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = F.lag("role").over(order)
    rows = rows.withColumns({"begins": before.isNull(), "opens": F.coalesce(before != F.col("role"), F.lit(True))})
    for size, start, length in ((F.length, "start", "len"), (F.octet_length, "first_byte", "bytes")):
        opening = F.when(F.col("begins"), 0).otherwise(len(END)) + len(TURN) + size(_escape_role(F.col("role"))) + 1
        rows = rows.withColumn(length, size(escape(F.col("text"))).cast("long")).withColumn("step", F.when(F.col("opens"), opening).otherwise(len(PART)) + F.col(length))
        rows = rows.withColumn(start, F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col(length))
    return rows


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (in characters and in UTF-8 bytes, from 0) from rows (conv_id, turn, role, text)."""
    rows = _placed(conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "start", "len", "first_byte", "bytes")))
    span = lambda t: F.struct(*(t[c].alias(c) for c in ("start", "len", "first_byte", "bytes")))
    shown = F.transform(
        F.col("blocks"),
        lambda b: F.concat(F.lit(TURN), _escape_role(b["role"]), F.lit("\n"), F.array_join(F.transform(b["parts"], escape), PART), F.lit(END)),
    )
    return (
        rows.groupBy("conv_id")
        .agg(turns.alias("turns"))
        .select("conv_id", _blocks(F.col("turns")).alias("blocks"), F.transform(F.filter("turns", lambda t: t["role"] == LOSS_ROLE), span).alias("loss_spans"))
        .select("conv_id", F.array_join(shown, "").alias("formatted"), "loss_spans")
    )


def read_conversations(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text), loss_text, parsed from ``format_conversations``."""

    def turns_of(block: Column) -> Column:
        body = F.substring(block, F.lit(1), F.length(block) - len(END))
        role = _unescape_role(F.substring_index(body, "\n", 1))
        rest = F.substring(body, F.instr(body, "\n") + 1, F.length(body))
        return F.transform(F.split(rest, r"<\|part\|>", -1), lambda p: F.struct(role.alias("role"), unescape(p).alias("text")))

    blocks = F.split(F.col("formatted"), r"<\|turn\|>", -1)
    # cut from bytes, where a place is found at once; a variable holds them, so they are not copied for every span
    cut = lambda b: F.transform("loss_spans", lambda s: unescape(F.substring(b, s["first_byte"].cast("int") + 1, s["bytes"].cast("int")).cast("string")))
    loss = F.get(F.transform(F.array(F.col("formatted").cast("binary")), cut), F.lit(0))
    return formatted.select(
        "conv_id",
        F.flatten(F.transform(F.slice(blocks, F.lit(2), F.size(blocks)), turns_of)).alias("turns"),
        F.array_join(loss, "").alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
