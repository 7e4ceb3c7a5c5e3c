"""Metrics of runs: one metrics.json in each run's folder, and processed results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RATES = "struct<tp:bigint,fp:bigint,fn:bigint,precision:double,recall:double,f1:double>"
SCHEMA = f"""run_id string, ts_epoch double, documents_processed_total bigint, overall_seconds double, mean_docs_per_second double,
 durations map<string,struct<p50:double,p95:double>>, evaluation map<string,struct<global_all_types:{_RATES},global_by_type:map<string,{_RATES}>>>"""


def read(spark: SparkSession, pattern: str | list[str]) -> DataFrame:
    """One row per metrics.json under the pattern or patterns, with its time of change."""
    rows = spark.read.schema(SCHEMA).option("multiLine", True).json(pattern)
    return rows.select("*", F.col("_metadata.file_modification_time").alias("mtime"))


def durations(runs: DataFrame) -> DataFrame:
    """run_id, component, p50, p95."""
    return runs.select("run_id", F.explode("durations").alias("component", "d")).select("run_id", "component", "d.p50", "d.p95")


def rates(runs: DataFrame) -> DataFrame:
    """run_id, variant, entity_type (null: all), precision, recall, f1."""
    rows = runs.select("run_id", F.explode("evaluation").alias("variant", "e"))
    total = rows.select("run_id", "variant", F.lit(None).cast("string").alias("entity_type"), "e.global_all_types.precision", "e.global_all_types.recall", "e.global_all_types.f1")
    typed = rows.select("run_id", "variant", F.explode("e.global_by_type").alias("entity_type", "r")).select("run_id", "variant", "entity_type", "r.precision", "r.recall", "r.f1")
    return total.unionByName(typed)


def processed(spark: SparkSession, path: str) -> DataFrame:
    """Result documents; malformed lines are skipped."""
    span = "array<struct<start:int,end:int,entity_type:string,id:string,confidence:double>>"
    return spark.read.schema(f"doc_id string, masked_text string, original_text string, evaluation string, ground_truth_entities {span}, predicted_entities {span}").json(path, mode="DROPMALFORMED")
