"""Chat formatting: turns become one training string per conversation, with a mask of what is learnt.

Turn structs are collected per conversation and sorted, adjacent turns of one role are merged into a block by array
aggregation, and the string is concatenated, all by Spark expressions. A block is ``### Role: `` followed by its turns,
each closed by ``</turn>``, and a line break. Inside roles and texts ``\\`` is written ``\\b``, ``###`` is ``\\h``,
``</turn>`` is ``\\t`` and, in roles only, ``:`` is ``\\c``, so a control string in a text can neither open nor close a turn and
reading back gives each original turn. The mask covers the texts of assistant turns, without markers.

Defined cases: a null text is empty; a null role is its own role, written ``~``; a null turn sorts first; rows with
equal turn are ordered by role, then text, and repeated rows stay repeated; a null conv_id is one conversation; an empty
table gives an empty result; other input columns are ignored. One conversation is one output row, so the longest
conversation has to fit in one cell (2 GB); running offsets come from a window, so work stays linear in its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KNOWN = {"user": "User", "assistant": "Assistant", "system": "System"}
END = "</turn>"
OPEN = "###"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(c, F.lit(OPEN), F.lit("\\h")), F.lit(END), F.lit("\\t"))


def unescape(c: Column) -> Column:
    """Inverse of escape: every backslash starts a two-letter code, so codes are undone one kind at a time, \\b last."""
    c = F.replace(F.replace(c, F.lit("\\h"), F.lit(OPEN)), F.lit("\\t"), F.lit(END))
    return F.replace(c, F.lit("\\b"), F.lit("\\"))


def role_label(role: Column) -> Column:
    out = F.when(role.isNull(), F.lit("~"))
    for name, label in KNOWN.items():
        out = out.when(role == name, F.lit(label))
    return out.otherwise(F.concat(F.lit("="), F.replace(escape(role), F.lit(":"), F.lit("\\c"))))


def label_role(label: Column) -> Column:
    out = F.when(label == "~", F.lit(None).cast("string"))
    for name, shown in KNOWN.items():
        out = out.when(label == shown, F.lit(name))
    return out.otherwise(unescape(F.replace(F.substring(label, F.lit(2), F.length(label)), F.lit("\\c"), F.lit(":"))))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_mask array<struct<start,length>> (code points of formatted, in order)."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("conv_id", "turn", "role", "text", role_label(F.col("role")).alias("label"), escape(F.col("text")).alias("body"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    # The header stands before the first turn of a block, the line break after its last one.
    first = (F.lag("label").over(order).isNull() | (F.lag("label").over(order) != F.col("label")))
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("head", first)
    header = F.concat(F.lit(f"{OPEN} "), F.col("label"), F.lit(": "))
    before = F.when(F.col("head"), F.length(header) + F.when(F.col("n") > 1, 1).otherwise(0)).otherwise(0)
    rows = rows.withColumn("before", before.cast("long"))
    size = F.col("before") + F.length("body") + len(END)
    rows = rows.withColumn("start", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("body") - len(END))
    # Turns are collected as structs, n first, so that sorting the array restores their order.
    turn = F.struct("n", "head", "label", "body", "start", (F.col("role") == learn).alias("learnt"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    starts = F.transform(F.filter("turns", lambda t: t["head"]), lambda t: t["n"])
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size("turns") + 1))
    spans = F.arrays_zip(starts.alias("from"), ends.alias("to"))
    chats = chats.select("conv_id", "turns", spans.alias("spans"))
    blocks = F.transform("spans", lambda s: F.slice("turns", s["from"], s["to"] - s["from"]))
    shown = F.transform(
        blocks,
        lambda b: F.concat(F.lit(f"{OPEN} "), b[0]["label"], F.lit(": "), F.array_join(F.transform(b, lambda t: F.concat(t["body"], F.lit(END))), "")),
    )
    mask = F.transform(F.filter("turns", lambda t: F.coalesce(t["learnt"], F.lit(False))), lambda t: F.struct(t["start"].alias("start"), F.length(t["body"]).cast("long").alias("length")))
    return chats.select("conv_id", F.concat(F.array_join(shown, "\n"), F.lit("\n")).alias("formatted"), mask.alias("loss_mask"))


def parse_chats(chats: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role,text>>, loss string: what formatted and its mask say, unescaped."""
    pieces = F.split("formatted", OPEN)
    blocks = F.slice(pieces, F.lit(2), F.size(pieces) - 1)

    def turns_of(block: Column) -> Column:
        at = F.instr(block, ": ")
        role = label_role(F.substring(block, F.lit(2), at - 2))
        bodies = F.split(F.substring(block, at + 2, F.length(block)), END)
        return F.transform(F.slice(bodies, 1, F.size(bodies) - 1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    turns = F.flatten(F.transform(blocks, turns_of))
    loss = F.array_join(F.transform("loss_mask", lambda m: unescape(F.substring("formatted", (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")
    return chats.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))


def digests(chats: DataFrame) -> DataFrame:
    """One row per formatted conversation with counts and digests of what is read back from it."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parse_chats(chats).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
