"""Text functions: escapes, names and labels as Columns; formatting of single values in Python."""

from __future__ import annotations

import datetime as dt
import math
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _escape(c: Column, marks: str) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for m in marks:
        out = F.replace(out, F.lit(m), F.lit("\\" + m))
    return out


def escape_measurement(c: Column) -> Column:
    return _escape(c, ", ")


def escape_key(c: Column) -> Column:
    """Tag keys, tag values and field keys."""
    return _escape(c, ", =")


def quote_field(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def host_name(i: Column) -> Column:
    return F.format_string("host-%04d", i.cast("long"))


def pid_name(i: Column) -> Column:
    return F.format_string("pid-%08d", i.cast("long"))


# The regions of generated series, in order.
REGIONS = ("us-east", "us-west", "eu-central", "ap-south")


def region_name(i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, REGIONS)), (i % len(REGIONS) + 1).cast("int"))


def series_label(name: Column, tags: Column) -> Column:
    """name{key=value,...} with keys in order; "series" for an empty name; no braces without tags."""
    pairs = F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    own = F.when(F.coalesce(name, F.lit("")) == "", "series").otherwise(name)
    return F.when(F.coalesce(F.size(tags), F.lit(0)) <= 0, own).otherwise(F.concat(own, F.lit("{"), F.array_join(pairs, ","), F.lit("}")))


def sanitize(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def format_float(x: float) -> str:
    """Four significant digits, trailing zeros cut."""
    return "%.4g" % x


def format_value(x) -> str:
    """A cell as text: null is empty, times in RFC 3339, floats in their shortest form without exponent."""
    if x is None:
        return ""
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, str):
        return clean_cell(x)
    if isinstance(x, float):
        if not math.isfinite(x):
            return "NaN" if math.isnan(x) else "+Inf" if x > 0 else "-Inf"
        s = repr(x)
        if "e" in s:
            s = format(__import__("decimal").Decimal(s), "f")
        return s.removesuffix(".0")
    if isinstance(x, dt.datetime):
        s = x.strftime("%Y-%m-%dT%H:%M:%S")
        return s + (f".{x.microsecond:06d}".rstrip("0") if x.microsecond else "") + "Z"
    return clean_cell(str(x))


def clean_cell(s: str) -> str:
    return re.sub(r"\s+", " ", s).strip()


def truncate(s: str, width: int) -> str:
    """At most width characters; what is cut ends in three points if there is room for them."""
    if len(s) <= width:
        return s
    return s[:width] if width <= 3 else s[: width - 3] + "..."


def cell_width(s: str) -> int:
    """Cells that a text takes on a terminal: two for wide characters, none for combining ones."""
    return sum(0 if unicodedata.combining(c) or unicodedata.category(c) in ("Cf", "Cc", "Me") else 1 + (unicodedata.east_asian_width(c) in "WF") for c in s)


def truncate_cells(s: str, width: int) -> str:
    """At most width cells; what is cut ends in three points, and points alone where nothing else fits."""
    if width <= 0 or cell_width(s) <= width:
        return s if width > 0 else ""
    kept, used = "", 0
    for c in s:
        used += cell_width(c)
        if used > width - 3:
            break
        kept += c
    return kept + "..." if kept else "." * min(3, width) if width <= 3 else "." * width


def one_line(s: str, most: int = 160) -> str:
    s = clean_cell(s)
    return s if len(s.encode()) <= most else s.encode()[: most - 3].decode(errors="ignore") + "..."


def format_latency(seconds: float) -> str:
    if seconds <= 0:
        return "-"
    ms = seconds * 1000
    if ms >= 1000:
        return f"{int(ms) / 1000:g}s"
    return f"{int(ms)}ms" if ms >= 1 else f"{ms * 1000:g}µs"


def parse_rate(text: str) -> int:
    """Points a second: a number with k or m behind it and /s, /sec, /second or ps after that; at least 1."""
    m = re.fullmatch(r"([0-9.]+)([km]?)(/sec|/second|/s|ps)?", text.strip().lower())
    try:
        rate = round(float(m[1]) * {"": 1, "k": 1e3, "m": 1e6}[m[2]]) if m else 0
    except ValueError:
        rate = 0
    if rate < 1:
        raise ValueError(f"invalid rate {text!r}")
    return rate


def parse_bool(text: str) -> bool:
    return text.strip().lower() in {"1", "t", "true", "y", "yes", "on"}


def clean_identifier(text: str) -> str:
    """The last dotted segment without quotes."""
    parts = re.findall(r'"(?:[^"\\]|\\.)*"|[^.]+', text.strip())
    return parts[-1].strip().strip('"') if parts else ""


def quote_identifier(text: str) -> str:
    """Each dotted part in double quotes, with \\ and " escaped."""
    return ".".join('"' + p.strip('"').replace("\\", "\\\\").replace('"', '\\"') + '"' for p in text.split("."))
