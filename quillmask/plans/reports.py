"""Small reports from aggregated frames: metrics.json, Markdown and HTML. All inputs are a few rows per component, type or run."""

from __future__ import annotations

import html
import json
import os
import secrets
import shutil
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compare, metrics
from .config import PipelineConfig, plain


def run_id(now: datetime | None = None) -> str:
    return f"run-{now or datetime.now():%Y%m%dT%H%M%S}-{secrets.token_hex(3)}"


def start_run(cfg: PipelineConfig, files: list[str] = ()) -> Path:
    """A new run folder with config.json, manifest.json and copies of the configuration files (numbered if names repeat)."""
    name = run_id()
    folder = Path(cfg.metrics.output_dir, name)
    (folder / "configs").mkdir(parents=True)
    for f in map(Path, files):
        target, n = folder / "configs" / f.name, 1
        while target.exists():
            target, n = folder / "configs" / f"{f.stem}-{n}{f.suffix}", n + 1
        shutil.copy(f, target)
    (folder / "config.json").write_text(json.dumps(plain(cfg), indent=1))
    (folder / "manifest.json").write_text(json.dumps({"run_id": name, "pid": os.getpid()}))
    return folder


def output_path(path: str, input_path: str, now: datetime | None = None) -> str:
    """The results' path: beside the input by default, with a time stamp where it exists."""
    stamp = f"{now or datetime.now():%Y%m%dT%H%M%S}"
    out = Path(path) if path else Path(input_path).with_name(f"{Path(input_path).stem}.results-{stamp}.jsonl")
    if out.suffix != ".jsonl":
        raise ValueError(f"not a .jsonl path: {out}")
    return str(out.with_name(f"{out.stem}-{stamp}{out.suffix}") if out.exists() else out)


def metrics_document(name: str, found: DataFrame, masked: DataFrame, summary: DataFrame | None, seconds: float) -> dict:
    """The run's metrics from aggregates."""
    docs = masked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("entities")), F.lit(0)).alias("masked")).first()
    lengths = metrics.pack(masked.select(F.length("original_text").alias("size")), [], "size", (0.5, 0.9, 0.99)).first().asDict()
    types = {r["entity_type"]: r["spans"] for r in metrics.detected(found).collect()}
    totals = {r["component"]: {"raw": r["raw"], "per_char": r["per_char"]} for r in metrics.totals(found, masked.withColumnRenamed("original_text", "text")).collect()}
    out = {
        "run_id": name, "documents_processed_total": docs["n"], "documents_failed_total": 0, "spans_detected_total": sum(types.values()), "spans_masked_total": docs["masked"], "overall_seconds": seconds,
        "mean_docs_per_second": docs["n"] / seconds if seconds else 0.0, "spans_detected_by_type": types, "span_counts": totals, "length_chars": lengths, "evaluation": {},
    }
    for r in summary.collect() if summary is not None else ():
        variant = out["evaluation"].setdefault(r["variant"], {"per_component_by_type": {}, "per_component_all_types": {}, "global_by_type": {}, "global_all_types": {}})
        rates = {k: r[k] for k in ("tp", "fp", "fn", "precision", "recall", "f1")}
        if r["scope"] == "global":
            if r["entity_type"]:
                variant["global_by_type"][r["entity_type"]] = rates
            else:
                variant["global_all_types"] = rates
        elif r["entity_type"]:
            variant["per_component_by_type"].setdefault(r["scope"], {})[r["entity_type"]] = rates
        else:
            variant["per_component_all_types"][r["scope"]] = rates
    return out


def markdown(summary: DataFrame) -> str:
    rows = summary.orderBy(compare.variant_order(F.col("variant")), compare.component_order(F.col("scope")), "scope", F.asc_nulls_first("entity_type")).collect()
    lines = ["| variant | scope | type | tp | fp | fn | precision | recall | f1 |", "| --- " * 9 + "|"]
    lines += [f"| {r['variant']} | {r['scope']} | {r['entity_type'] or 'all'} | {r['tp']} | {r['fp']} | {r['fn']} | {r['precision']:.4g} | {r['recall']:.4g} | {r['f1']:.4g} |" for r in rows]
    return "\n".join(lines) + "\n"


def table_html(rows: DataFrame, title: str, heat: str | None = None) -> str:
    """A table of a small frame; the heat column, from -1 to 1, colours its row."""
    head = "".join(f"<th>{html.escape(c)}</th>" for c in rows.columns)
    body = []
    for r in rows.collect():
        shade = f' style="background:hsl({120 if r[heat] > 0 else 0},70%,{100 - 40 * abs(r[heat]):.0f}%)"' if heat and r[heat] is not None else ""
        body.append(f"<tr{shade}>" + "".join(f"<td>{html.escape(f'{v:.4g}' if isinstance(v, float) else str(v))}</td>" for v in r) + "</tr>")
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr>{head}</tr>{''.join(body)}</table>"
