"""Text forms of results: table, sparkline, chart, JSON. Points are reduced in the cluster; only what is drawn is collected."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import format_float, format_value, truncate
from .operators import series as ops

GLYPHS = "▁▂▃▄▅▆▇█"
FORMATS = ("table", "sparkline", "chart", "json", "auto")
MAX_ROWS, MAX_SERIES = 200, 5
NO_ROWS, NO_POINTS = "no rows", "no numeric time-series points"


def normalize_format(name: str) -> str:
    low = name.strip().lower() or "table"
    if low not in FORMATS:
        raise ValueError(f"unsupported format {name!r}")
    return low


@dataclass
class Line:
    """A reduced series."""

    label: str
    values: list[float]
    low: float
    high: float
    mean: float
    points: int
    levels: list[int]
    rows: list[int]


def reduced(series: DataFrame, width: int, most: int = MAX_SERIES) -> tuple[list[Line], int]:
    """The first series, reduced to `width` values each, and how many more there are. series: name, tags, time, value."""
    keyed = series.withColumn("label", ops_label()).withColumn("__at", F.monotonically_increasing_id())
    total = keyed.select("label").distinct().count()
    own = ops.first_series(keyed, ["label"], most, ["__at"])
    stats = {r["label"]: r for r in ops.stats(own, ["label"]).collect()}
    order = [r["label"] for r in own.groupBy("label").agg(F.min("__at").alias("m")).orderBy("m").collect()]
    small = ops.downsample(own, ["label"], ["time", "__at"], width)
    drawn = ops.chart_rows(ops.levels(small, ["label"]), own, ["label"]).orderBy("label", "bucket").collect()
    out = []
    for label in order:
        if label in stats:
            mine, s = [r for r in drawn if r["label"] == label], stats[label]
            out.append(Line(label, [r["value"] for r in mine], s["min_value"], s["max_value"], s["avg_value"], s["points"], [r["level"] for r in mine], [r["row"] for r in mine]))
    return out, max(0, total - most)


def ops_label():
    from .functions.text import series_label

    return series_label(F.col("name"), F.col("tags"))


def table(df: DataFrame, max_rows: int = MAX_ROWS, width: int | None = None) -> str:
    """Columns two spaces apart under a dashed rule; at most max_rows rows and a note of the rest; columns cut to fit a width, or at 48 without one."""
    rows = df.limit(max_rows + 1).collect()
    if not df.columns or not rows:
        return NO_ROWS
    more = df.count() - max_rows if len(rows) > max_rows else 0
    cells = [[format_value(x) for x in r] for r in rows[:max_rows]]
    widths = limited([max(len(x) for x in col) for col in zip(df.columns, *cells)], width)
    show = lambda r: "  ".join(truncate(x, w).ljust(w) for x, w in zip(r, widths)).rstrip()
    out = [show(df.columns), "  ".join("-" * w for w in widths), *map(show, cells)]
    return "\n".join([*out, f"... {more} more rows"] if more else out)


def limited(widths: list[int], total: int | None) -> list[int]:
    if not total:
        return [min(w, 48) for w in widths]
    widths = list(widths)
    while sum(widths) + 2 * (len(widths) - 1) > total:
        k = max(range(len(widths)), key=lambda i: (widths[i], -i))
        if widths[k] <= 8:
            break
        widths[k] -= 1
    return widths


def sparkline(series: DataFrame, width: int = 60, most: int = MAX_SERIES) -> str:
    lines, more = reduced(series, max(8, min(120, width or 60)), most)
    out = [f"{x.label}  {''.join(GLYPHS[n] for n in x.levels)}  min={format_float(x.low)} max={format_float(x.high)} avg={format_float(x.mean)} points={x.points}" for x in lines]
    if more:
        out.append(f"... {more} more series")
    return "\n".join(out) or NO_POINTS


def chart(series: DataFrame, width: int = 80, most: int = MAX_SERIES, height: int = 8) -> str:
    width = max(24, min(140, width or 80))
    shown, more = reduced(series, max(8, width - 12), most)
    blocks = [_plot(x, width, height) for x in shown]
    if more:
        blocks.append(f"... {more} more series")
    return "\n\n".join(blocks) or NO_POINTS


def _plot(x: Line, width: int, height: int) -> str:
    labels = [format_float(x.high), *[""] * (height - 2), format_float(x.low)]
    left = max(4, *map(len, labels))
    grid = [[" "] * len(x.rows) for _ in range(height)]
    for k, row in enumerate(x.rows):
        if k:
            a, b = sorted((x.rows[k - 1], row))
            for y in range(a + 1, b):
                grid[y][k - 1] = "|"
        grid[row][k] = "*"
    lines = [f"{x.label} min={format_float(x.low)} max={format_float(x.high)} avg={format_float(x.mean)} points={x.points}"]
    lines += [f"{label.rjust(left)} |{''.join(g)}".rstrip() for label, g in zip(labels, grid)]
    return "\n".join([*lines, " " * left + " +" + "-" * max(8, len(x.rows))])


def as_json(df: DataFrame, series: DataFrame | None = None, metadata: dict[str, object] | None = None) -> str:
    """The whole result: columns, rows, series with their points (null if there are none) and counters. Rows are fetched part by part; a cap belongs into the query (LIMIT)."""
    rows = [r.asDict(recursive=True) for r in df.toLocalIterator()]
    found: dict[str, dict] = {}
    for r in series.withColumn("label", ops_label()).toLocalIterator() if series is not None else []:
        own = found.setdefault(r["label"], {"name": r["name"], "tags": r["tags"], "points": []})
        own["points"].append({"time": r["time"], "value": r["value"]})
    counters = {"rows": len(rows), "points": sum(len(s["points"]) for s in found.values()), "series": len(found)}
    out = {"columns": df.columns, "rows": rows, "series": list(found.values()) or None, "metadata": {**(metadata or {}), **counters}}
    return json.dumps(out, indent=2, default=str, ensure_ascii=False)


def summary(rows: int | None, points: int = 0, series: int = 0, max_rows: int = MAX_ROWS) -> str:
    """One line on a result; rows is None if it has no table."""
    parts = []
    if rows is not None:
        parts.append(f"rows {rows} shown {max_rows}" if 0 < max_rows < rows else f"rows {rows}")
    parts += [f"{what} {n}" for what, n in (("points", points), ("series", series)) if n > 0]
    return ", ".join(parts)


def result_summary(df: DataFrame | None, series: DataFrame | None = None, max_rows: int = MAX_ROWS) -> str:
    """summary() of a result, counted in the cluster."""
    n = series.agg(F.count("*").alias("points"), F.count_distinct(ops_label()).alias("series")).first() if series is not None else (0, 0)
    return summary(None if df is None else df.count(), n[0], n[1], max_rows)


def render(df: DataFrame, fmt: str = "table", series: DataFrame | None = None, width: int | None = None, max_rows: int = MAX_ROWS, max_series: int = MAX_SERIES, metadata: dict[str, object] | None = None) -> str:
    """auto: a sparkline if there are series, else a table; series formats without series fall back to the table."""
    fmt = normalize_format(fmt)
    if fmt == "json":
        return as_json(df, series, metadata)
    if fmt == "table" or series is None or (fmt == "auto" and series.isEmpty()):
        return table(df, max_rows, width)
    return chart(series, width or 80, max_series) if fmt == "chart" else sparkline(series, width or 60, max_series)


def status_line(parts: dict[str, object], width: int = 80) -> str:
    """A divider of 20 to 160 dashes and the parts."""
    return "-" * max(20, min(160, width)) + "\n" + " | ".join(f"{k}: {v if v not in (None, '') else '-'}" for k, v in parts.items())
