"""Counts, quantiles and throughput of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def detected(found: DataFrame, component_types: DataFrame | None = None) -> DataFrame:
    """entity_type, spans; with component_types only types that their component supports."""
    if component_types is not None:
        found = found.join(component_types, ["component", "entity_type"], "left_semi")
    return found.groupBy(F.coalesce("entity_type", F.lit("UNKNOWN")).alias("entity_type")).agg(F.count("*").alias("spans"))


def totals(found: DataFrame, docs: DataFrame, text_col: str = "text", empty: float = 0.0) -> DataFrame:
    """component, raw (spans), per_char (sum over documents of spans / length, where an empty text's share is `empty`; null texts don't count)."""
    per_doc = found.groupBy("doc_id", "component").agg(F.count("*").alias("n")).join(docs.select("doc_id", F.length(text_col).alias("size")), "doc_id")
    return per_doc.groupBy("component").agg(F.sum("n").alias("raw"), F.sum(F.when(F.col("size") > 0, F.col("n") / F.col("size")).when(F.col("size") == 0, F.lit(empty))).alias("per_char"))


def nearest_rank(value: str, points: tuple[float, ...]) -> list[Column]:
    """pNN columns: the value of rank max(1, ceil(p n)); 0 for no values."""
    return [F.coalesce(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").cast("double"), F.lit(0.0)).alias(f"p{round(100 * p)}") for p in points]


def pack(rows: DataFrame, by: list[str], value: str, points: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.groupBy(*by).agg(F.count(value).alias("n"), zero(F.min(value).cast("double")).alias("min"), zero(F.max(value).cast("double")).alias("max"), zero(F.avg(value)).alias("mean"), *nearest_rank(value, points))


def cdf(rows: DataFrame, value: str) -> DataFrame:
    """value, share of rows at or below it, one row per distinct value: counts first, so the running sum is over distinct values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    # Distinct values are dealt over ranges of their own; a range needs only the sums of those before it.
    part = counts.withColumn("part", F.floor(F.log2(F.greatest(F.col(value), F.lit(0)) + 1) * 4))
    before = part.groupBy("part").agg(F.sum("n").alias("m"))
    before = before.withColumn("before", F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("m").over(Window.partitionBy()))
    run = F.sum("n").over(Window.partitionBy("part").orderBy(value))
    return part.join(before, "part").select(value, ((F.col("before") + run) / F.col("all")).alias("share"))


def throughput(timings: DataFrame) -> DataFrame:
    """docs, seconds, docs_per_second from (doc_id, seconds): documents over the sum of their own seconds."""
    per = timings.groupBy("doc_id").agg(F.sum("seconds").alias("s")).agg(F.count("*").alias("docs"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("seconds"))
    return per.withColumn("docs_per_second", F.coalesce(F.try_divide(F.col("docs").cast("double"), F.col("seconds")), F.lit(0.0)))
