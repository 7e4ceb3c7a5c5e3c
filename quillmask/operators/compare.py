"""Comparison of runs and ranking of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans

#: Variants by preference as a run's headline.
PREFERRED = ("exact", "iou@0.50", "iou@0.5", "iou@0.75", "iou@0.80", "iou@0.8")


def delta(base: Column, new: Column) -> tuple[Column, Column]:
    """new - base, and that in per cent of base; null where base is (almost) 0."""
    return new - base, F.when(F.abs(base) > 1e-12, (new - base) / base * 100)


def shown(value: Column) -> Column:
    """Four digits after the point, with its sign; n/a where it is unknown."""
    return F.when(value.isNull(), "n/a").otherwise(F.format_string("%+.4f", value))


def diff(runs: DataFrame, baseline: str, candidate: str, keys: list[str], value: str) -> DataFrame:
    """keys, baseline, candidate, delta, pct over the keys of either run. runs: run_id, keys, value."""
    side = lambda run, name: runs.where(F.col("run_id") == run).select(*keys, F.col(value).alias(name))
    both = side(baseline, "baseline").join(side(candidate, "candidate"), keys, "full_outer")
    d, pct = delta(F.col("baseline"), F.col("candidate"))
    return both.select(*keys, "baseline", "candidate", d.alias("delta"), pct.alias("pct"))


def multi_diff(runs: DataFrame, baseline: str, keys: list[str], value: str) -> DataFrame:
    """run_id, keys, baseline, candidate, delta, pct, heat (delta over the greatest absolute one) for every other run."""
    others = runs.where(F.col("run_id") != baseline).select("run_id").distinct()
    base = runs.where(F.col("run_id") == baseline).select(*keys, F.col(value).alias("baseline")).crossJoin(F.broadcast(others))  # a row per run
    new = runs.where(F.col("run_id") != baseline).select("run_id", *keys, F.col(value).alias("candidate"))
    d, pct = delta(F.col("baseline"), F.col("candidate"))
    rows = base.join(new, ["run_id", *keys], "full_outer").select("run_id", *keys, "baseline", "candidate", d.alias("delta"), pct.alias("pct"))
    most = rows.agg(F.max(F.abs("delta")).alias("_most"))
    return rows.crossJoin(F.broadcast(most)).withColumn("heat", F.coalesce(F.try_divide("delta", "_most"), F.lit(0.0))).drop("_most")


def top_changes(changes: DataFrame, n: int = 10) -> DataFrame:
    """The n greatest gains and losses by delta: side, rank and the row."""
    key = [c for c in changes.columns if c not in ("delta", "pct", "baseline", "candidate")]
    out = []
    for side, order in (("improvement", F.desc("delta")), ("regression", F.asc("delta"))):
        best = changes.where(F.col("delta") > 0 if side == "improvement" else F.col("delta") < 0).orderBy(order, *key).limit(n)
        out.append(best.select(F.lit(side).alias("side"), F.row_number().over(Window.orderBy(order, *key)).alias("rank"), *changes.columns))  # over n rows
    return out[0].unionByName(out[1])


def primary_variant(variants: DataFrame) -> DataFrame:
    """run_id, variant: the most preferred variant of each run, else the first by name."""
    rank = F.coalesce(F.element_at(F.create_map(*[x for i, v in enumerate(PREFERRED) for x in (F.lit(v), F.lit(i))]), F.col("variant")), F.lit(99))
    return variants.groupBy("run_id").agg(F.min_by("variant", F.struct(rank.alias("r"), F.col("variant").alias("v"))).alias("variant"))


def variant_order(variant: Column) -> Column:
    """Sort key: IoU thresholds ascending, by-id after plain, then exact_by_id, then exact."""
    threshold = F.regexp_extract(variant, r"^iou@([0-9.]+)", 1).try_cast("double")
    return F.struct(F.when(variant.startswith("iou@"), 0).when(variant == "exact_by_id", 1).otherwise(2).alias("k"), F.coalesce(threshold, F.lit(0.0)).alias("t"), variant.endswith("_by_id").alias("i"))


def component_order(component: Column) -> Column:
    """The number of type:NN-Name, 10000 without one."""
    return F.coalesce(F.regexp_extract(component, r"(?:^|:)(\d+)-", 1).try_cast("int"), F.lit(10_000))


def latest_day(runs: DataFrame) -> DataFrame:
    """Runs of the latest day (from run-YYYYMMDDT... ids, else from the time of change) with baseline = the oldest of them. runs: run_id, mtime."""
    day = F.coalesce(F.nullif(F.regexp_extract("run_id", r"^run-(\d{8})T", 1), F.lit("")), F.date_format("mtime", "yyyyMMdd"))
    rows = runs.withColumn("day", day)
    last = rows.join(F.broadcast(rows.agg(F.max("day").alias("day"))), "day")
    first = last.agg(F.min_by("run_id", F.struct("mtime", "run_id")).alias("baseline"))
    return last.crossJoin(F.broadcast(first)).select("run_id", "mtime", "day", "baseline")


def scored_documents(counts: DataFrame) -> DataFrame:
    """doc_id, tp, fp, fn and rates, null where their denominator is 0."""
    rows = counts.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    p, r, f = spans.precision_recall_f1_or_null(F.col("tp"), F.col("fp"), F.col("fn"))
    return rows.select("doc_id", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def worst(scored: DataFrame, n: int, by: str = "f1") -> DataFrame:
    """The n worst documents: lowest f1, precision or recall (unknown last), or most errors."""
    order = [F.desc(F.col("fp") + F.col("fn"))] if by == "errors" else [F.asc_nulls_last(by)]
    return scored.orderBy(*order, "doc_id").limit(max(0, n))


def found_page(scored: DataFrame, search: str, page: int, size: int, by: str = "f1") -> DataFrame:
    """A page of documents whose id contains the search text, any case."""
    hits = scored.where(F.contains(F.lower(F.col("doc_id").cast("string")), F.lit(search.lower())))
    return hits.orderBy(F.asc_nulls_first(by), "doc_id").offset(page * size).limit(size)
