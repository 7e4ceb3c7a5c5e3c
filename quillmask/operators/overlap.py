"""Overlap resolution: a greedy walk over a document's candidate spans by priority.

Candidates come sorted by (priority, hierarchy, component, place in it). One that conflicts with no kept span is kept. One that
conflicts only with spans of other priorities is dropped. Otherwise it meets the first kept span of its own priority that it
conflicts with: same component and bounds drop it; else higher confidence, then length, then earlier start wins, and a winner takes that one
span's place at the end of the list. Spans conflict if their IoU is over the threshold and their types are equal (or the policy is
cross_type). The whole walk is one array expression per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kinds, spans

LAST = 1_000_000  # the priority of types that a component declares none for
ITEM = "struct<prio:int,hier:int,comp_idx:int,det_idx:int,start:int,stop:int,entity_type:string,confidence:double,component:string,id:string,replacement:string>"


def deduplicated(found: DataFrame) -> DataFrame:
    """The first span of each component, bounds and type."""
    first = Window.partitionBy("doc_id", "component", "start", "stop", "entity_type").orderBy("det_idx")
    return found.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def ranked(found: DataFrame, priorities: DataFrame | None = None, hierarchy: DataFrame | None = None) -> DataFrame:
    """prio from (component, entity_type, prio), 1 000 000 if none; hier from (component, hier), 0 if none."""
    if priorities is not None:
        found = found.join(priorities, ["component", "entity_type"], "left")
    else:
        found = found.withColumn("prio", F.lit(None).cast("int"))
    found = found.join(hierarchy, "component", "left") if hierarchy is not None else found.withColumn("hier", F.lit(0))
    return found.withColumn("prio", F.coalesce("prio", F.lit(LAST))).withColumn("hier", F.coalesce("hier", F.lit(0)))


def walk(candidates: Column, threshold: float, cross_type: bool) -> Column:
    """Kept spans in order of keeping; candidates is an array of ITEM."""

    def conflict(k: Column, x: Column) -> Column:
        same = F.coalesce(k["entity_type"] == x["entity_type"], F.lit(False))
        return (F.lit(True) if cross_type else same) & (spans.iou(k["start"], k["stop"], x["start"], x["stop"]) > threshold)

    def weight(s: Column) -> Column:
        return F.struct(F.coalesce(s["confidence"], F.lit(0.0)).alias("c"), (s["stop"] - s["start"]).alias("l"), (-s["start"]).alias("s"))

    def step(acc: Column, x: Column) -> Column:
        met = F.slice(F.filter(acc, lambda k: (k["prio"] == x["prio"]) & conflict(k, x)), 1, 1)
        wins = F.exists(met, lambda k: ~((k["comp_idx"] == x["comp_idx"]) & (k["start"] == x["start"]) & (k["stop"] == x["stop"])) & (weight(x) > weight(k)))
        return F.when(~F.exists(acc, lambda k: conflict(k, x)), F.array_append(acc, x)).when(wins, F.array_append(F.array_except(acc, met), x)).otherwise(acc)

    ordered = F.array_sort(candidates)
    return F.aggregate(ordered, F.slice(ordered, 1, 0), step)


def resolved(found: DataFrame, threshold: float = 0.75, policy: str = "same_type_only") -> DataFrame:
    """doc_id, entities array<ITEM> in order of keeping; needs prio and hier."""
    rows = deduplicated(found.withColumn("entity_type", kinds.canonical(F.col("entity_type"))))
    item = F.struct(*[F.col(c) for c in ("prio", "hier", "comp_idx", "det_idx", "start", "stop", "entity_type", "confidence", "component", "id", "replacement")]).cast(ITEM)
    grouped = rows.groupBy("doc_id").agg(F.collect_list(item).alias("candidates"))
    return grouped.select("doc_id", walk(F.col("candidates"), threshold, policy == "cross_type").alias("entities"))
