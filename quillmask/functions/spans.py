"""Scalar expressions over spans (half-open, in code points) and rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    shared = F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))
    union = (a1 - a0) + (b1 - b0) - shared
    return F.when((shared > 0) & (union > 0), shared / union).otherwise(0.0)


def clamped(x: Column, text: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.length(text), x))


def piece(text: Column, start: Column, stop: Column) -> Column:
    return F.substring(text, start + 1, stop - start)


def mention(text: Column, span: Column) -> Column:
    return F.coalesce(span["replacement"], piece(text, clamped(span["start"], text), clamped(span["stop"], text)))


def rate(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def precision_recall_f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p, r = rate(tp, tp + fp), rate(tp, tp + fn)
    return p, r, rate(2 * p * r, p + r)


def precision_recall_f1_or_null(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return p, r, F.try_divide(2 * p * r, p + r)


def escaped_html(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def squeezed(text: Column) -> Column:
    """Runs of white space as one space each."""
    return F.regexp_replace(text, r"(?U)\s+", " ")


def squeezed_places(text: Column) -> Column:
    """For each character of squeezed(text) its place in text; a run of white space has its first one's."""
    first = lambda i: ~F.substring(text, i + 1, F.lit(1)).rlike(r"(?U)^\s") | (i == 0) | ~F.substring(text, i, F.lit(1)).rlike(r"(?U)^\s")
    return F.when(F.length(text) > 0, F.filter(F.sequence(F.lit(0), F.length(text) - 1), first)).otherwise(F.array().cast("array<int>"))
