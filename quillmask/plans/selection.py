"""python -m quillmask.plans.selection RUN...: compares runs by their metrics.json; writes JSON and HTML and prints a table.

RUN is a run's folder or its metrics.json. Two: baseline and candidate. More: the first is the baseline. One: a candidate, against the latest other
run beside it or --baseline. None: all runs of the latest day under --runs, the oldest as baseline; with --no-same-day, or if that day has one
run only, the latest two.
"""

from __future__ import annotations

import argparse
import json
import re
import sys
from datetime import datetime
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import compare
from ..sources import runs as stored
from . import reports


def folder_of(path: str | Path) -> Path:
    found = Path(path)
    found = found.parent if found.name == "metrics.json" else found
    if not (found / "metrics.json").exists():
        raise ValueError(f"no metrics.json in {found}")
    return found


def newest_first(base: str | Path) -> list[Path]:
    found = [p.parent for p in Path(base).glob("*/metrics.json")]
    return sorted(found, key=lambda p: ((p / "metrics.json").stat().st_mtime, p.name), reverse=True)


def day_of(run: Path) -> str:
    """From a name run-YYYYMMDDT..., else from the time of change."""
    if m := re.match(r"run-(\d{8})T", run.name):
        return m[1]
    return f"{datetime.fromtimestamp((run / 'metrics.json').stat().st_mtime):%Y%m%d}"


def chosen(named: list[str], base: str | Path = "runs", baseline: str | None = None, same_day: bool = True) -> list[Path]:
    """The runs to compare, baseline first."""
    if len(named) > 1:
        return [folder_of(x) for x in named]
    if named:
        candidate = folder_of(named[0])
        others = [folder_of(baseline)] if baseline else [p for p in newest_first(candidate.parent) if p != candidate]
        if not others:
            raise ValueError(f"no other run beside {candidate}")
        return [others[0], candidate]
    runs = newest_first(base)
    if baseline:
        first = folder_of(baseline)
        others = [p for p in runs if p.resolve() != first.resolve()]
        if not others:
            raise ValueError(f"no run in {base} besides the baseline")
        return [first, others[0]]
    if same_day and runs:
        last = max(map(day_of, runs))
        if len(alike := [p for p in runs if day_of(p) == last]) > 1:
            return alike[::-1]
    if len(runs) < 2:
        raise ValueError(f"fewer than two runs in {base}")
    return [runs[1], runs[0]]


def main(argv: list[str]) -> int:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("named", nargs="*", metavar="RUN")
    parser.add_argument("--runs", default="runs", help="folder of runs")
    parser.add_argument("--baseline")
    parser.add_argument("--no-same-day", dest="same_day", action="store_false")
    parser.add_argument("--value", default="f1", choices=("precision", "recall", "f1"))
    parser.add_argument("--out", help="folder of the reports; else that of the runs")
    args = parser.parse_args(argv)
    folders = chosen(args.named, args.runs, args.baseline, args.same_day)
    spark = SparkSession.builder.appName("quillmask-compare").getOrCreate()
    rows = stored.rates(stored.read(spark, [str(p / "metrics.json") for p in folders]))
    names = {json.loads((p / "metrics.json").read_text())["run_id"]: p for p in folders}
    first, *others = names
    keys = ["variant", "entity_type"]
    rows = rows.withColumn("entity_type", F.coalesce("entity_type", F.lit("all"))).select("run_id", *keys, args.value)
    changes = compare.diff(rows, first, others[0], keys, args.value) if len(others) == 1 else compare.multi_diff(rows, first, keys, args.value)
    changes = changes.orderBy(*[c for c in ("run_id", *keys) if c in changes.columns])
    out = Path(args.out or folders[0].parent)
    out.mkdir(parents=True, exist_ok=True)
    title = f"compare-{first}-vs-{others[0] if len(others) == 1 else f'{len(others)}-runs'}"
    found = [r.asDict() for r in changes.collect()]  # a row for each variant, type and run
    (out / f"{title}.json").write_text(json.dumps({"baseline": first, "candidates": others, "value": args.value, "rows": found}, indent=1))
    (out / f"{title}.html").write_text(reports.table_html(changes, title, "heat" if "heat" in changes.columns else None))
    changes.show(100, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
