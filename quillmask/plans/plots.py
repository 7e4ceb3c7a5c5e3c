"""Plots of runs: the frames behind them, and SVG of frames of a few rows (nothing to install)."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COLOURS = ("#4477aa", "#ee6677", "#228833", "#ccbb44", "#66ccee", "#aa3377")
WIDTH, HEIGHT, EDGE = 640, 320, 40


def grouped(rows: DataFrame, bar: str, label: str, value: str) -> DataFrame:
    """bar, label, value: one bar of each colour in each group."""
    return rows.select(F.col(bar).alias("bar"), F.col(label).alias("label"), F.col(value).alias("value"))


def stacked(rows: DataFrame, label: str, parts: list[str]) -> DataFrame:
    """label, part, n, base: each part on top of those before it."""
    pieces = F.array(*[F.struct(F.lit(p).alias("part"), F.lit(i).alias("k"), F.col(p).cast("long").alias("n")) for i, p in enumerate(parts)])
    long = rows.select(label, F.inline(pieces))
    below = Window.partitionBy(label).orderBy("k")
    return long.select(label, "part", "n", (F.sum("n").over(below) - F.col("n")).alias("base"))


def _page(body: list[str], title: str) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" font-family="sans-serif" font-size="11"><text x="{EDGE}" y="16">{html.escape(title)}</text>{"".join(body)}</svg>'


def cdf_svg(rows: DataFrame, x: str, title: str) -> str:
    """A line through (x, share) of a frame as metrics.cdf() gives it, already small or sampled by the caller."""
    points = rows.orderBy(x).select(x, "share").collect()
    top = max([float(p[0]) for p in points] or [1.0]) or 1.0
    at = lambda p: f"{EDGE + (WIDTH - 2 * EDGE) * float(p[0]) / top:.1f},{HEIGHT - EDGE - (HEIGHT - 2 * EDGE) * p[1]:.1f}"
    return _page([f'<polyline fill="none" stroke="{COLOURS[0]}" points="{" ".join(map(at, points))}"/>'], title)


def bars_svg(rows: DataFrame, title: str) -> str:
    """Bars of a frame label, value, and bar (colour within the label) or part and base (stacked)."""
    found = [r.asDict() for r in rows.collect()]
    label = next((c for c in rows.columns if c not in ("value", "n", "bar", "part", "base")), "label")
    value = "value" if "value" in rows.columns else "n"
    colour = next((c for c in ("bar", "part") if c in rows.columns), None)
    labels, bars = sorted({str(r[label]) for r in found}), sorted({str(r[colour]) for r in found}) if colour else [""]
    top = max([float(r[value] or 0) + float(r.get("base") or 0) for r in found] or [1.0]) or 1.0
    room = (WIDTH - 2 * EDGE) / max(1, len(labels))
    wide = room * 0.8 if "base" in rows.columns else room * 0.8 / len(bars)
    scale = (HEIGHT - 2 * EDGE) / top
    body = []
    for r in found:
        k = bars.index(str(r[colour])) if colour else 0
        left = EDGE + labels.index(str(r[label])) * room + (0 if "base" in rows.columns else k * wide)
        high, base = float(r[value] or 0) * scale, float(r.get("base") or 0) * scale
        body.append(f'<rect x="{left:.1f}" y="{HEIGHT - EDGE - base - high:.1f}" width="{wide:.1f}" height="{high:.1f}" fill="{COLOURS[k % len(COLOURS)]}"><title>{html.escape(f"{r[label]} {r.get(colour, "") if colour else ""} {r[value]}")}</title></rect>')
    body += [f'<text x="{EDGE + i * room:.1f}" y="{HEIGHT - EDGE + 14}">{html.escape(x)}</text>' for i, x in enumerate(labels)]
    return _page(body, title)
