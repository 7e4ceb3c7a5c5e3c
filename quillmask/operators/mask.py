"""Masking: spans of a text are replaced by [TYPE], [TYPE<id>] or asterisks in one fold over the text's sorted spans.

By default the walk never goes back: what lies under an overlapping span stays hidden. compat=True follows span ends even
backwards, so overlapping spans can show text again that an earlier span hid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans


def token(method: str, kind: Column, id_: Column, length: Column) -> Column:
    if method == "ASTERISK":
        return F.repeat(F.lit("*"), length)
    if method != "ENTITY_TAG":
        raise ValueError(f"unknown mask method {method}")
    known = F.when(kind.isNull(), F.raise_error(F.lit("a span without a type can't be tagged"))).otherwise(kind)
    return F.concat(F.lit("["), known, F.coalesce(id_, F.lit("")), F.lit("]"))


def spliced(text: Column, entities: Column, render, compat: bool = False) -> Column:
    """text with each entity (start, stop) replaced by render(entity, start, stop); entities sorted by start."""

    def step(acc: Column, s: Column) -> Column:
        a, b = spans.clamped(s["start"], text), spans.clamped(s["stop"], text)
        gap = F.when(a > acc["at"], spans.piece(text, acc["at"], a)).otherwise("")
        at = b if compat else F.greatest(acc["at"], b)
        return F.when(b > a, F.struct(at.alias("at"), F.array_append(acc["out"], F.concat(gap, render(s, a, b))).alias("out"))).otherwise(acc)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(entities, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))


def by_start(entities: Column) -> Column:
    """Stable sort by start."""
    keyed = F.transform(entities, lambda s, i: F.struct(s["start"].alias("start"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def masked(docs: DataFrame, entities: DataFrame, method: str = "ENTITY_TAG", compat: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, original_text, masked_text, entities (sorted by start) for every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(entities, "doc_id", "left")
    rows = rows.withColumn("entities", by_start(F.col("entities")))
    out = spliced(F.col("text"), F.col("entities"), lambda s, a, b: token(method, s["entity_type"], s["id"], b - a), compat)
    return rows.select("doc_id", F.col("text").alias("original_text"), F.coalesce(out, F.col("text")).alias("masked_text"), "entities")


def highlighted(text: Column, entities: Column) -> Column:
    """HTML with a mark around each span."""
    escape = spans.escaped_html

    def step(acc: Column, s: Column) -> Column:
        a, b = spans.clamped(s["start"], text), spans.clamped(s["stop"], text)
        mark = F.concat(F.lit('<mark title="'), F.coalesce(s["entity_type"], F.lit("UNKNOWN")), F.lit('">'), escape(spans.piece(text, a, b)), F.lit("</mark>"))
        piece = F.concat(escape(spans.piece(text, acc["at"], a)), mark)
        return F.when((b > a) & (a >= acc["at"]), F.struct(b.alias("at"), F.array_append(acc["out"], piece).alias("out"))).otherwise(acc)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = lambda acc: F.concat(F.array_join(acc["out"], ""), escape(F.substring(text, acc["at"] + 1, F.length(text))))
    return F.coalesce(F.aggregate(by_start(entities), start, step, done), escape(text))
