"""Answers of a remote masking service, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def masked_text(body: Column) -> Column:
    """The first of the usual fields that is not empty, else the body itself."""
    fields = ("$.masked_text", "$.maskedText", "$.text", "$.choices[0].message.content")
    return F.coalesce(*[F.nullif(F.get_json_object(body, f), F.lit("")) for f in fields], body)


def truncated(original: Column, masked: Column, reason: Column, announced: Column, received: Column, fraction: float = 0.6) -> Column:
    """Whether an answer looks cut off: by its stop reason, by its announced length, by a short text without an end mark, or by an open token."""
    by_reason = F.lower(reason).isin("length", "max_tokens", "maxtokens")
    by_length = F.coalesce(announced.try_cast("bigint") > received, F.lit(False))
    tail = F.rtrim(F.right(masked, F.lit(64)))
    short = (F.length(masked) < fraction * F.length(original)) & (F.length(masked) > 0) & ~tail.rlike(r"[.!?)\]]\z")
    after = F.length(masked) - F.length(F.regexp_extract(masked, r"(?s)\A.*\[(.*)\z", 1))
    open_token = masked.contains("[") & ~F.rtrim(masked).endswith("]") & ~F.substring(masked, after + 1, F.length(masked)).contains("]")
    return F.coalesce(by_reason, F.lit(False)) | by_length | F.coalesce(short, F.lit(False)) | F.coalesce(open_token, F.lit(False))
