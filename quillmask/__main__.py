"""python -m quillmask --config run.yml: one offline run per configuration."""

from __future__ import annotations

import json
import sys
import time

from pyspark.sql import SparkSession

from . import logs
from .operators import evaluate, models  # noqa: F401  models registers detectors
from .plans import config, pipeline, reports
from .sources import jsonl


def main(argv: list[str]) -> None:
    logger = logs.set_up()
    spark = SparkSession.builder.appName("quillmask").getOrCreate()
    for cfg in config.from_command_line(argv):
        began = time.time()
        d = cfg.data
        docs = jsonl.read(spark, d.input_path, d.text_field, d.doc_id_field, d.ground_truth_field)
        result = pipeline.build(spark, cfg, docs)
        out = reports.output_path(d.output_path, d.input_path)
        jsonl.write(result.masked, out)
        if cfg.metrics.enabled:
            folder = reports.start_run(cfg)
            summary = evaluate.summed(result.counts) if result.counts is not None else None
            found = reports.metrics_document(folder.name, result.spans, result.masked, summary, time.time() - began)
            (folder / "metrics.json").write_text(json.dumps(found))
            if summary is not None:
                (folder / "summary.md").write_text(reports.markdown(summary))
        logger.info("wrote %s", out)


if __name__ == "__main__":
    main(sys.argv[1:])
