"""Epoch numbers and timestamps at the precisions h, m, s, ms, u, ns, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nanoseconds of each precision.
UNIT_NS = {"h": 3_600_000_000_000, "m": 60_000_000_000, "s": 1_000_000_000, "ms": 1_000_000, "u": 1_000, "ns": 1}
_SAME = {"": "ns", "rfc3339": "ns", "rfc3339nano": "ns", "n": "ns", "ns": "ns", "u": "u", "us": "u", "ms": "ms", "s": "s", "m": "m", "h": "h"}


def precision(name: str | None) -> str:
    """The canonical precision of a write or a dataset; raises for others."""
    key = (name or "").strip().lower()
    if key not in _SAME:
        raise ValueError(f"unsupported precision {name!r}")
    return _SAME[key]


def write_precision(name: str | None) -> str:
    """The precision parameter of a write request: left out for times in text form, other names lower-cased."""
    key = (name or "").strip().lower()
    return {"": "", "rfc3339": "", "rfc3339nano": "", "n": "n", "ns": "n", "u": "u", "us": "u"}.get(key, key)


def asks_for_epoch(name: str | None) -> bool:
    """Whether a query with this precision asks for numeric epochs ("n" is for writes only)."""
    return (name or "").strip().lower() in {"ns", "u", "us", "ms", "s", "m", "h"}


def to_ns(value: Column, unit: str | None) -> Column:
    """Whole epoch numbers to nanoseconds; null where that exceeds a long. Unknown units count as ns."""
    return F.try_multiply(value.cast("long"), F.lit(UNIT_NS.get(_SAME.get((unit or "").lower(), "ns"), 1)).cast("long"))


def text_to_ns(text: Column, unit: str | None) -> Column:
    """Epoch lexemes to nanoseconds: with a point or exponent by rounding half away from zero, else exactly."""
    fractional = text.rlike("[.eE]")
    scaled = F.round(text.try_cast("double") * F.lit(float(UNIT_NS.get(_SAME.get((unit or "").lower(), "ns"), 1))), 0)
    inside = (scaled < F.lit(9.223372036854775e18)) & (scaled > F.lit(-9.223372036854775e18))
    return F.when(fractional, F.when(inside, scaled.cast("long"))).otherwise(to_ns(text.try_cast("long"), unit))


def ns_to_time(ns: Column) -> Column:
    """Timestamp of nanoseconds, down to the microsecond below."""
    return F.timestamp_micros(F.floor(ns / F.lit(1000).cast("decimal(20,0)")).cast("long"))


def to_time(value: Column, unit: str | None) -> Column:
    """Timestamp of whole epoch numbers, down to the microsecond below, also where nanoseconds exceed a long; null beyond the microseconds of one. Unknown units count as ns."""
    ns = UNIT_NS.get(_SAME.get((unit or "").lower(), "ns"), 1)
    if ns < UNIT_NS["u"]:
        return ns_to_time(value.cast("long"))
    return F.timestamp_micros(F.try_multiply(value.cast("long"), F.lit(ns // UNIT_NS["u"]).cast("long")))


def micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def encode(time: Column, unit: str) -> Column:
    """Epoch number of a timestamp: hours and minutes toward zero, seconds and milliseconds down, u and ns exact."""
    us, key = micros(time), precision(unit)
    if key == "ns":
        return us * 1000
    if key == "u":
        return us
    if key == "ms":
        return F.floor(us / F.lit(1000)).cast("long")
    second = F.floor(us / F.lit(1_000_000)).cast("long")
    if key == "s":
        return second
    parts = second / F.lit(UNIT_NS[key] // UNIT_NS["s"])
    return F.when(second >= 0, F.floor(parts)).otherwise(F.ceil(parts)).cast("long")
