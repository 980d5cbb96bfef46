"""Small results as text: terminal, Markdown, CSV and SVG. Nothing here sees more than a bounded number of points."""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from html import escape
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.functions.text import csv_safe, markdown_safe, sparkline, terminal_safe
from runledger.operators.downsample import downsample, histogram_values, missing_markers
from runledger.operators.written import written
from runledger.plans.inspect import Comparison, Inspection
from runledger.plans.sessions import write_json

KINDS = ("line", "scatter", "step", "histogram")


def number(x: Any) -> str:
    return "-" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x)


def inspection_text(i: Inspection, fields: list[str] | None = None, quality: bool = False, ascii_only: bool = False) -> str:
    out = [f"{terminal_safe(i.source)}  {i.format}  {i.record_count} records, {i.valid_record_count} valid, {i.invalid_record_count} invalid"]
    for name, kind in i.fields.items():
        if fields and name not in fields:
            continue
        m = i.metrics.get(name)
        tail = f"  mean {number(m['mean'])}  median {number(m['median'])}  {number(m['minimum'])} .. {number(m['maximum'])}  {sparkline(m['sparkline_values'], ascii_only)}" if m else ""
        out.append(f"  {terminal_safe(name)}: {kind}{tail}")
    for title, values in (("timing", i.timing), *i.engineering.items()):
        if values:
            out.append(f"{title}: " + ", ".join(f"{k} {number(v)}" for k, v in values.items()))
    if quality or i.quality:
        out += [f"findings: {len(i.quality)}", *(f"{f['severity']}: {f['check_id']} {terminal_safe(f['field'] or '')} [{f['affected']}] {f['explanation']}" for f in i.quality)]
    return "\n".join(out) + "\n"


def csv_cell(value: Any) -> str:
    text = "" if value is None else str(csv_safe(value))
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\r\n') else text


def comparison_text(c: Comparison, kind: str = "terminal") -> str:
    if kind == "json":
        return json.dumps(c.to_dict(), ensure_ascii=False, indent=2, sort_keys=True) + "\n"
    rows = [(name, label, mean, d["comparable"], d.get("improvement_percent", {}).get(label)) for name, d in c.fields.items() for label, mean in d["means"].items()]
    head = ("field", "source", "mean", "comparable", "improvement_percent")
    if kind == "csv":
        return "\n".join(",".join(map(csv_cell, r)) for r in [head, *rows]) + "\n"
    if kind == "markdown":
        lines = [f"| {' | '.join(head)} |", "|" + "-|" * len(head)] + [f"| {' | '.join(markdown_safe(number(x)) for x in r)} |" for r in rows]
        return "\n".join([*lines, "", *(f"- {markdown_safe(w)}" for w in c.warnings)]) + "\n"
    if kind != "terminal":
        raise ValueError("a comparison is terminal, json, markdown or csv")
    return "\n".join([*("  ".join(terminal_safe(number(x)) for x in r) for r in [head, *rows]), *(f"warning: {w}" for w in c.warnings)]) + "\n"


COLOURS = ["#1f6f8b", "#b5532a", "#5b7f2b", "#7a4b94", "#8a6d1d"]
WIDTH, HEIGHT, PAD = 900, 360, 40


def _svg(shapes: list[tuple], legend: list[str]) -> bytes:
    out = []
    for kind, colour, at in shapes:
        if kind == "bar":
            out.append(f'<rect x="{at[0]:.1f}" y="{at[1]:.1f}" width="{at[2]:.1f}" height="{at[3]:.1f}" fill="{colour}"/>')
        elif kind == "dot":
            out.append(f'<circle cx="{at[0]:.1f}" cy="{at[1]:.1f}" r="2" fill="{colour}"/>')
        elif kind == "mark":
            out.append(f'<path d="M{at[0]:.1f} {at[1]:.1f} v6" stroke="#a00"/>')
        else:
            out.append(f'<polyline fill="none" stroke="{colour}" points="{" ".join(f"{a:.1f},{b:.1f}" for a, b in at)}"/>')
    names = "".join(f'<text x="{PAD}" y="{16 + 14 * k}" font-size="12" fill="{COLOURS[k % 5]}">{escape(n)}</text>' for k, n in enumerate(legend))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}">{names}{"".join(out)}</svg>\n'.encode()


def _png(shapes: list[tuple]) -> bytes:
    """The shapes as pixels; names stand in the metadata beside the file."""
    canvas = np.full((HEIGHT, WIDTH, 3), 255, np.uint8)
    canvas[HEIGHT - PAD, PAD : WIDTH - PAD] = canvas[PAD : HEIGHT - PAD, PAD] = 200

    def put(x, y, colour: str) -> None:
        x, y = np.atleast_1d(np.rint(x).astype(int)), np.atleast_1d(np.rint(y).astype(int))
        inside = (x >= 0) & (x < WIDTH) & (y >= 0) & (y < HEIGHT)
        canvas[y[inside], x[inside]] = [int(colour[k : k + 2], 16) for k in (1, 3, 5)]

    for kind, colour, at in shapes:
        if kind == "bar":
            x, y = np.meshgrid(np.arange(at[0], at[0] + max(1, at[2])), np.arange(at[1], at[1] + at[3]))
            put(x.ravel(), y.ravel(), colour)
        elif kind == "dot":
            x, y = np.meshgrid(np.arange(-1, 2), np.arange(-1, 2))
            put(at[0] + x.ravel(), at[1] + y.ravel(), colour)
        elif kind == "mark":
            put(np.full(6, at[0]), at[1] + np.arange(6), "#aa0000")
        else:
            for (a, b), (c, d) in zip(at[:-1], at[1:], strict=True):
                n = int(max(abs(c - a), abs(d - b))) + 2
                put(np.linspace(a, c, n), np.linspace(b, d, n), colour)
    rows = np.concatenate([np.zeros((HEIGHT, 1), np.uint8), canvas.reshape(HEIGHT, -1)], axis=1).tobytes()
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, HEIGHT, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def plot(cells: DataFrame, fields: list[str], output: str, time_field: str | None = None, kind: str = "line", most: int = 5000, overwrite: bool = False) -> dict[str, Any]:
    """An SVG or PNG of one session's fields with ``.meta.json`` beside it. Points are thinned in Spark; their extrema stay."""
    if kind not in KINDS:
        raise ValueError(f"a plot is one of {', '.join(KINDS)}")
    if most < 2:
        raise ValueError("a plot needs two points or more")
    if not output.lower().endswith((".svg", ".png")):
        raise ValueError("a plot is an .svg or .png file")
    if not fields:
        raise ValueError("a plot needs a field")
    for path in (output, f"{output}.meta.json"):
        if os.path.islink(path):
            raise ValueError("a plot may not be a link")
        if os.path.exists(path) and not overwrite:
            raise FileExistsError(f"{path} exists")
    named = cells.filter(F.col("field").isin(*fields))
    x = F.col("record_index").cast("double")
    series = named.select("session_id", "field", "record_index", x.alias("x"), F.col("num").alias("y"))
    if time_field:
        times = cells.filter(F.col("field") == time_field).select(F.col("session_id").alias("s"), F.col("record_index").alias("r"), F.col("t"))
        series = named.join(times, (F.col("session_id") == F.col("s")) & (F.col("record_index") == F.col("r"))).filter("t is not null").select("session_id", "field", "record_index", F.col("t").alias("x"), F.col("num").alias("y"))
    series = written(series, "series")
    totals = {r.field: r for r in series.groupBy("field").agg(F.count("y").alias("n"), F.count_if(F.col("y").isNull()).alias("missing"), F.min("y").alias("lo"), F.max("y").alias("hi")).collect()}
    shapes: list[tuple] = []
    drawn: dict[str, list[float]] = {}
    marks: dict[str, int] = {}
    if kind == "histogram":
        drawn = {}
        for r in histogram_values(series, most).orderBy("field", "i").toLocalIterator():
            drawn.setdefault(r.field, []).append(r.y)
        bars = []
        for name in fields:
            if values := drawn.get(name):
                counts, edges = np.histogram(values, 10)
                bars += [(name, float(a), float(b), int(n)) for n, a, b in zip(counts, edges[:-1], edges[1:], strict=True)]
        low, high, top = min((b[1] for b in bars), default=0.0), max((b[2] for b in bars), default=1.0), max((b[3] for b in bars), default=1)
        for name, a, b, n in bars:
            scale, h = (WIDTH - 2 * PAD) / ((high - low) or 1), (HEIGHT - 2 * PAD) * n / top
            shapes.append(("bar", COLOURS[fields.index(name) % 5], (PAD + (a - low) * scale, HEIGHT - PAD - h, max(1.0, (b - a) * scale - 1), h)))
    else:
        points = downsample(series, most).orderBy("field", "record_index").collect()
        gone = missing_markers(series, most).orderBy("field", "record_index").collect()
        xs, ys = [p.x for p in [*points, *gone]] or [0.0], [p.y for p in points] or [0.0]
        px = lambda v: PAD + (WIDTH - 2 * PAD) * (v - min_x) / span_x
        py = lambda v: HEIGHT - PAD - (HEIGHT - 2 * PAD) * (v - min_y) / span_y
        min_x, min_y, span_x, span_y = min(xs), min(ys), (max(xs) - min(xs)) or 1, (max(ys) - min(ys)) or 1
        for k, name in enumerate(fields):
            own = [(px(p.x), py(p.y)) for p in points if p.field == name]
            drawn[name] = [p.y for p in points if p.field == name]
            if kind == "scatter":
                shapes += [("dot", COLOURS[k % 5], at) for at in own]
            elif own:
                path = [own[0]]
                for a, b in own[1:]:
                    path += [(a, path[-1][1]), (a, b)] if kind == "step" else [(a, b)]
                shapes.append(("line", COLOURS[k % 5], path))
            missing = [m for m in gone if m.field == name]
            marks[name] = len(missing)
            shapes += [("mark", "", (px(m.x), HEIGHT - PAD)) for m in missing]
    if not any(drawn.values()) and not any(marks.values()):
        raise ValueError("the fields hold no number")
    meta: dict[str, Any] = {"kind": kind, "time_field": time_field, "max_points": most, "bucket_policy": "first, last, smallest and largest of each bucket", "fields": {}}
    for name in fields:
        if t := totals.get(name):
            own = drawn.get(name, [])
            meta["fields"][name] = {
                "original_points": t.n + t.missing, "plotted": len(own), "missing_markers": marks.get(name, 0), "original_missing": t.missing if kind != "histogram" else 0, "downsampled": len(own) < t.n or (kind != "histogram" and marks[name] < t.missing),
                "minimum": t.lo, "maximum": t.hi, "preserved_global_extrema": not t.n or {t.lo, t.hi} <= set(own),
            }
    meta |= {"original_points": sum(f["original_points"] for f in meta["fields"].values()), "plotted": sum(f["plotted"] + f["missing_markers"] for f in meta["fields"].values()), "downsampled": any(f["downsampled"] for f in meta["fields"].values())}
    part = f"{output}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(_png(shapes) if output.lower().endswith(".png") else _svg(shapes, fields))
    os.replace(part, output)
    write_json(f"{output}.meta.json", meta)
    return meta
