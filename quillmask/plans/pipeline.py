"""The masking pipeline: documents to detections, ids, non-overlapping entities, masked texts and evaluation, as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kinds, spans
from ..operators import detect, evaluate, mask, overlap, resolve
from .config import DetectorConfig, PipelineConfig

#: Detectors by type: (documents, configuration, component, comp_idx) -> spans. Models and services register their own.
DETECTORS: dict[str, Callable[[DataFrame, DetectorConfig, str, int], DataFrame]] = {}


def register(kind: str, detector: Callable[[DataFrame, DetectorConfig, str, int], DataFrame]) -> None:
    """The first registration of a type holds."""
    DETECTORS.setdefault(kind.upper(), detector)


register("REGEX", lambda docs, c, name, i: detect.by_pattern(docs, name, i, min_confidence=c.min_confidence))


@dataclass(frozen=True)
class Result:
    spans: DataFrame
    masked: DataFrame
    counts: DataFrame | None


def components(cfg: PipelineConfig) -> list[tuple[str, int, DetectorConfig]]:
    return [(f"{i:02d}-{d.type}", i, d) for i, d in enumerate(cfg.detectors, 1)]


def _types(d: DetectorConfig) -> tuple[str, ...]:
    family = {"HOSTED_MASKER_API": "HOSTED", "MASKER_API": "HOSTED"}.get(d.type, d.type)
    return kinds.FAMILIES[family][0]


def dimension(spark: SparkSession, cfg: PipelineConfig) -> DataFrame:
    """component, entity_type, prio, hier: one row per declared type; a few rows, local."""
    rows = [(name, t, d.priority.get(t), d.hierarchy_position) for name, _, d in components(cfg) for t in _types(d)]
    schema = T.StructType([T.StructField("component", T.StringType()), T.StructField("entity_type", T.StringType()), T.StructField("prio", T.IntegerType()), T.StructField("hier", T.IntegerType())])
    return spark.createDataFrame(rows, schema)


def with_ids(found: DataFrame, threshold: float, cache: DataFrame | None) -> DataFrame:
    """Spans with the ids of their mentions; order of mentions is that of components and of spans in them."""
    ordered = found.withColumn("_o", F.struct("comp_idx", "det_idx"))
    rank = ordered.groupBy("doc_id").agg(F.array_sort(F.collect_list("_o")).alias("_all"))
    rows = ordered.join(rank, "doc_id").select(*found.columns, F.array_position("_all", F.col("_o")).cast("int").alias("ord"))
    mentions = rows.select("doc_id", "entity_type", "ord", "start", F.col("replacement").alias("mention"))
    ids = resolve.resolved(mentions, threshold, cache).join(rows.select("doc_id", "ord", "start", "stop"), ["doc_id", "ord"])
    return resolve.written_back(found, ids)


def build(spark: SparkSession, cfg: PipelineConfig, docs: DataFrame, cache: DataFrame | None = None) -> Result:
    """docs: doc_id, text and, for evaluation, gold (array of spans, null: not evaluated)."""
    found = None
    for name, i, d in components(cfg):
        if d.type not in DETECTORS:
            raise ValueError(f"no detector is registered for {d.type}")
        part = DETECTORS[d.type](docs, d, name, i)
        found = part if found is None else found.unionByName(part)
    for r in cfg.resolvers:
        found = with_ids(found, r.threshold, cache)
    dims = dimension(spark, cfg)
    ranked = overlap.ranked(found, F.broadcast(dims.select("component", "entity_type", "prio")), F.broadcast(dims.select("component", "hier").distinct()))  # as many rows as types are declared
    entities = overlap.resolved(ranked, cfg.overlap.iou_threshold, cfg.overlap.overlap_policy)
    masked = mask.masked(docs, entities, cfg.masker.method, cfg.masker.compat)
    counts = None
    if cfg.evaluator.enabled and "gold" in docs.columns:
        golds = docs.where("gold is not null").select("doc_id", F.posexplode("gold").alias("ord", "s")).select("doc_id", "ord", "s.start", "s.stop", "s.entity_type", "s.id")
        evaluable = docs.where("gold is not null").select("doc_id")
        final = masked.join(evaluable, "doc_id", "left_semi").select("doc_id", F.posexplode("entities").alias("ord", "s")).select("doc_id", "ord", "s.start", "s.stop", "s.entity_type", "s.id")
        each = found.join(evaluable, "doc_id", "left_semi").select("component", "doc_id", F.col("det_idx").alias("ord"), "start", "stop", "entity_type", "id")
        p, g = evaluate.scoped(each, golds, F.broadcast(dims))
        pairs = evaluate.paired(p.unionByName(final.withColumn("scope", F.lit("global"))), g.unionByName(golds.withColumn("scope", F.lit("global"))))
        e = cfg.evaluator
        counts = evaluate.evaluated(pairs, e.report_exact, e.report_by_id, tuple(e.report_iou_thresholds), e.optimal_id_mapping)
    return Result(found, masked, counts)


def mentions_of(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Spans with the text they stand for."""
    return found.join(docs.select("doc_id", "text"), "doc_id").withColumn("mention", spans.mention(F.col("text"), F.struct("replacement", "start", "stop"))).drop("text")
