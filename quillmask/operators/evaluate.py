"""Evaluation of predicted spans against gold spans.

Variants: exact, iou@t, and both by id. Predictions and golds meet per (scope, document, type); predictions are matched in order to the best
unused gold (first on ties). By-id variants first map predicted ids one to one to gold ids by the number of span pairs that match,
greedily or by an optimal assignment, so that ids only have to agree up to renaming.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import pairwise

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kinds, spans
from .dealing import dealt

THRESHOLDS = (0.10, 0.25, 0.50, 0.75, 0.90)
_SPAN = "struct<ord:int,start:int,stop:int,id:string>"
_ABSENT = 10**9


def scoped(preds: DataFrame, golds: DataFrame, component_types: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Predictions and golds with a scope: each component against the golds of the types it supports. preds: component; both: doc_id, ord, entity_type, start, stop, id."""
    if component_types is None:
        components = preds.select("component").distinct()
        p, g = preds, golds.crossJoin(F.broadcast(components))  # one row per configured component
    else:
        types = component_types.select("component", F.col("entity_type").alias("_t")).distinct()
        p = preds.join(types, (preds["component"] == types["component"]) & (kinds.canonical(preds["entity_type"]) == types["_t"]), "left_semi")
        g = golds.join(types, kinds.canonical(F.col("entity_type")) == F.col("_t")).drop("_t")
    return p.withColumnRenamed("component", "scope"), g.withColumnRenamed("component", "scope")


def paired(preds: DataFrame, golds: DataFrame, component_types: DataFrame | None = None) -> DataFrame:
    """scope, doc_id, entity_type, p, g: arrays in order. preds and golds have scope.

    With component_types, preds have component and golds neither: scopes are as scoped() makes them, but after the shuffle, which then holds every gold once.
    """
    if component_types is not None:
        preds, golds = preds.withColumnRenamed("component", "scope"), golds.withColumn("scope", F.lit(None).cast("string"))
    fields = [F.col(c).cast(t).alias(c) for c, t in (("ord", "int"), ("start", "int"), ("stop", "int"), ("id", "string"))]
    kind = F.coalesce(kinds.canonical(F.col("entity_type")), F.lit("UNKNOWN")).alias("entity_type")
    side = lambda rows, n: rows.select("scope", "doc_id", kind, F.lit(n).alias("side"), *fields)
    both = dealt(side(preds, 0).unionByName(side(golds, 1)))
    if component_types is not None:
        types = component_types.select(F.col("component").alias("_c"), F.col("entity_type").alias("_t")).distinct()
        both = both.join(F.broadcast(types), (F.col("entity_type") == F.col("_t")) & ((F.col("side") == 1) | (F.col("scope") == F.col("_c")))).withColumn("scope", F.col("_c"))
    of = lambda n: F.array_sort(F.collect_list(F.when(F.col("side") == n, F.struct("ord", "start", "stop", "id")))).cast(f"array<{_SPAN}>")
    return both.groupBy("scope", "doc_id", "entity_type").agg(of(0).alias("p"), of(1).alias("g"))


def greedy_matches(p: Column, g: Column, threshold: float | None) -> Column:
    """Number of predictions that find a gold; threshold None: equal bounds. A threshold of 0 matches disjoint spans too."""

    def score(a: Column, b: Column) -> Column:
        if threshold is None:
            return ((a["start"] == b["start"]) & (a["stop"] == b["stop"])).cast("double")
        return spans.iou(a["start"], a["stop"], b["start"], b["stop"])

    least = 1.0 if threshold is None else threshold

    def step(used: Column, a: Column) -> Column:
        ranked = F.transform(g, lambda b, j: F.struct((-score(a, b)).alias("s"), j.alias("j")))
        free = F.filter(ranked, lambda r: ~F.array_contains(used, r["j"]) & (-r["s"] >= least))
        best = F.array_min(free)
        return F.when(best.isNull(), used).otherwise(F.array_append(used, best["j"]))

    return F.size(F.aggregate(p, F.array().cast("array<int>"), step))


def counted(pairs: DataFrame, variant: str, threshold: float | None) -> DataFrame:
    """scope, doc_id, variant, entity_type, tp, fp, fn."""
    if threshold is None:
        # Equal bounds: one-to-one matching is the multiset intersection.
        bounds = lambda c: F.transform(c, lambda s: F.struct(s["start"], s["stop"]))
        count = lambda xs, b: F.size(F.filter(xs, lambda y: y == b))
        tp = F.aggregate(F.array_distinct(bounds(F.col("p"))), F.lit(0), lambda acc, b: acc + F.least(count(bounds(F.col("p")), b), count(bounds(F.col("g")), b)))
    else:
        tp = greedy_matches(F.col("p"), F.col("g"), threshold)
    rows = pairs.withColumn("tp", tp.cast("long"))
    return rows.select("scope", "doc_id", F.lit(variant).alias("variant"), "entity_type", "tp", (F.size("p") - F.col("tp")).cast("long").alias("fp"), (F.size("g") - F.col("tp")).cast("long").alias("fn"))


def assignment(cost: list[list[float]]) -> list[tuple[int, int]]:
    """Rows and columns of a least-cost assignment (shortest augmenting paths with potentials); the matrix is padded to a square with zeros."""
    n = max(len(cost), len(cost[0]) if cost else 0)
    at = lambda i, j: cost[i][j] if i < len(cost) and j < len(cost[0]) else 0.0
    u, v, owner = [0.0] * n, [0.0] * n, [-1] * n
    for row in range(n):
        slack, via, seen = [float("inf")] * n, [-1] * n, [False] * n
        i, last = row, -1
        while True:
            best = -1
            for j in range(n):
                if not seen[j]:
                    if (d := at(i, j) - u[i] - v[j]) < slack[j]:
                        slack[j], via[j] = d, last
                    if best < 0 or slack[j] < slack[best]:
                        best = j
            step = slack[best]
            u[row] += step
            for j in range(n):
                if seen[j]:
                    u[owner[j]] += step
                    v[j] -= step
                else:
                    slack[j] -= step
            seen[best], last = True, best
            if owner[best] < 0:
                break
            i = owner[best]
        while last >= 0:
            owner[last] = owner[via[last]] if via[last] >= 0 else row
            last = via[last]
    return sorted((i, j) for j, i in enumerate(owner) if i < len(cost) and j < len(cost[0]))


def _iou(a, b) -> float:
    shared = min(a[1], b[1]) - max(a[0], b[0])
    union = a[1] - a[0] + b[1] - b[0] - shared
    return shared / union if shared > 0 and union > 0 else 0.0


def by_id_matches(p: Sequence[tuple], g: Sequence[tuple], threshold: float | None, optimal: bool) -> int:
    """Matches of one document and type; spans are (start, stop, id)."""
    if not p or not g:
        return 0
    clusters: list[dict[str, list]] = [{}, {}]
    for side, rows in zip(clusters, (p, g), strict=True):
        for k, s in enumerate(rows):
            if s[2] is not None:
                side.setdefault(s[2], []).append(k)
    if threshold is None:
        near = lambda a, b: 1.0 if a[:2] == b[:2] else None
    else:
        near = lambda a, b: d if (d := _iou(a, b)) >= threshold else None
    mine, theirs = (list(c) for c in clusters)
    score = [[sum(near(p[a], g[b]) is not None for a in clusters[0][x] for b in clusters[1][y]) for y in theirs] for x in mine]
    mapping: dict[str, str] = {}
    if optimal:
        if mine and theirs:
            found = assignment([[-s if s else _ABSENT for s in row] for row in score])
            mapping = {mine[i]: theirs[j] for i, j in found if score[i][j]}
    else:
        first = {y: min(g[b][0] for b in clusters[1][y]) for y in theirs}
        ranked = sorted(((-s, first[theirs[j]], i, j) for i, row in enumerate(score) for j, s in enumerate(row) if s), key=lambda c: c[:2])
        taken: set[str] = set()
        for _, _, i, j in ranked:
            if mine[i] not in mapping and theirs[j] not in taken:
                mapping[mine[i]] = theirs[j]
                taken.add(theirs[j])
    used: set[int] = set()
    for a in p:
        goal = mapping.get(a[2]) if a[2] is not None else None
        if goal is None:
            continue
        free = [(-d, b) for b in clusters[1][goal] if b not in used and (d := near(a, g[b])) is not None]
        if free:
            used.add(min(free)[1])
    return len(used)


def _rows(column: pa.ListArray) -> list[tuple]:
    """The spans of each row of a batch as tuples (start, stop, id); only plain lists of numbers and ids are made of the batch."""
    flat, at = column.flatten(), column.offsets.to_pylist()
    rows = list(zip(*(pc.struct_field(flat, n).to_pylist() for n in ("start", "stop", "id")), strict=True))
    return [tuple(rows[a - at[0] : b - at[0]]) for a, b in pairwise(at)]


def counted_by_id(pairs: DataFrame, variant: str, threshold: float | None, optimal: bool = False) -> DataFrame:
    """Like counted(), with agreeing ids; the id assignment of one document and type is made in a worker, once for short lists that come again."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(1 << 14)(lambda p, g: by_id_matches(p, g, threshold, optimal))
        for part in it:
            both = [(p, g) for p, g in zip(_rows(part.column("p")), _rows(part.column("g")), strict=True)]
            tp = [known(p, g) if len(p) + len(g) <= 16 else by_id_matches(p, g, threshold, optimal) for p, g in both]
            counts = (tp, [len(p) - n for (p, _), n in zip(both, tp, strict=True)], [len(g) - n for (_, g), n in zip(both, tp, strict=True)])
            keys = ["scope", "doc_id", "entity_type"]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), *(pa.array(c, pa.int64()) for c in counts)], names=[*keys, "tp", "fp", "fn"])

    kind = pairs.schema["doc_id"].dataType.simpleString()
    rows = pairs.mapInArrow(run, f"scope string, doc_id {kind}, entity_type string, tp long, fp long, fn long")
    return rows.select("scope", "doc_id", F.lit(variant).alias("variant"), "entity_type", "tp", "fp", "fn")


def evaluated(pairs: DataFrame, exact: bool = True, by_id: bool = True, thresholds: tuple[float, ...] = THRESHOLDS, optimal: bool = False) -> DataFrame:
    """All variants of all pairs."""
    out = []
    for name, t in ([("exact", None)] if exact else []) + [(f"iou@{t:.2f}", t) for t in thresholds]:
        out.append(counted(pairs, name, t))
        if by_id:
            out.append(counted_by_id(pairs, f"{name}_by_id", t, optimal))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows


def summed(counts: DataFrame) -> DataFrame:
    """scope, variant, entity_type (null: all types), tp, fp, fn, precision, recall, f1 over all documents."""
    rows = counts.groupingSets([["scope", "variant", "entity_type"], ["scope", "variant"]], "scope", "variant", "entity_type").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    p, r, f = spans.precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return rows.select("scope", "variant", "entity_type", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def set_sides(preds: DataFrame, golds: DataFrame, key: tuple[str, ...] = ("doc_id", "start", "stop", "entity_type")) -> DataFrame:
    """Every distinct key of either side, with p and g: whether that side has it. Nulls are equal."""
    side = lambda rows, p: rows.select(*key, F.lit(p).alias("p"), F.lit(not p).alias("g"))
    return dealt(side(preds, True).unionByName(side(golds, False))).groupBy(*key).agg(F.max("p").alias("p"), F.max("g").alias("g"))


def exact_sets(preds: DataFrame, golds: DataFrame) -> DataFrame:
    """doc_id, tp, fp, fn over distinct (start, stop, type name); a key with a null equals none."""
    both = set_sides(preds, golds)
    known = F.lit(True)
    for c in both.columns[:-2]:
        known = known & F.col(c).isNotNull()
    hit = F.col("p") & F.col("g") & known
    return both.groupBy("doc_id").agg(F.count_if(hit).alias("tp"), F.count_if(F.col("p") & ~hit).alias("fp"), F.count_if(F.col("g") & ~hit).alias("fn"))
