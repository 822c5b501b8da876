"""Completion of meta commands and queries, from the catalog's cached names."""

from __future__ import annotations

import re
from concurrent.futures import CancelledError, ThreadPoolExecutor
from dataclasses import dataclass, field

from .functions.text import clean_identifier
from .sources.catalog import Catalog

# The words offered.
META = [":cancel", ":clear", ":db", ":dbs", ":fields", ":fmt", ":format", ":help", ":hist", ":history", ":measurements", ":msts", ":q", ":refresh", ":rp", ":rps", ":schema", ":status", ":tags", ":use"]
KEYWORDS = ["AND", "DATABASES", "FROM", "GROUP BY", "LIMIT", "MEASUREMENTS", "OR", "ORDER BY", "RETENTION POLICIES", "SELECT", "SHOW", "WHERE", "now()", "time"]
AFTER_SELECT = ["FROM", "GROUP BY", "LIMIT", "ORDER BY", "WHERE"]
_CLAUSES = {"select", "from", "where", "group", "order", "limit", "offset", "fill", "slimit", "soffset", "tz"}


@dataclass
class Completion:
    prefix: str
    candidates: list[str] = field(default_factory=list)


def matching(prefix: str, *lists: list[str]) -> Completion:
    """Candidates that begin with the prefix, whatever its case, once each and in order."""
    low = prefix.lower()
    return Completion(prefix, sorted({c for x in lists for c in x if c.lower().startswith(low)}))


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"?|\'(?:[^\'\\]|\\.)*\'?|[\w.]+|[^\s\w]')


def _tokens(text: str) -> list[tuple[str, int]]:
    """(token, depth of parentheses) of a query."""
    out, depth = [], 0
    for m in _TOKEN.finditer(text):
        depth -= m[0] == ")"
        out.append((m[0], depth))
        depth += m[0] == "("
    return out


def measurement_of(text: str) -> str:
    """The measurement behind the FROM outside parentheses; the last of its names, without quotes."""
    m = _tokens(text)
    for k, (t, depth) in enumerate(m):
        if t.lower() == "from" and depth == 0 and k + 1 < len(m):
            parts, k = [m[k + 1][0]], k + 2
            while k + 1 < len(m) and m[k][0] == ".":
                parts.append(m[k + 1][0])
                k += 2
            name = "".join(p if p.startswith('"') else p for p in parts[-1:])
            return "" if name.lower() in _CLAUSES or not re.match(r'["\w]', name) else clean_identifier(name)
    return ""


def _clause(tokens: list[tuple[str, int]]) -> str:
    found = ""
    for t, depth in tokens:
        if depth == 0 and t.lower() in _CLAUSES:
            found = t.lower()
    return found


def complete(catalog: Catalog, line: str, cursor: int | None = None, database: str | None = None, policy: str | None = None) -> Completion:
    """Candidates at the cursor: commands behind a colon; measurements behind FROM; tags in WHERE and GROUP BY; fields inside a function; fields, tags and clauses in SELECT; else keywords."""
    cursor = len(line) if cursor is None else cursor
    head = line[:cursor]
    prefix = re.search(r"[\w:.]*$", head)[0]
    if head.lstrip().startswith(":"):
        return _meta(catalog, head.lstrip(), database, policy)
    prefix = prefix.rsplit(".", 1)[-1]
    before = _tokens(head[: len(head) - len(prefix)])
    clause, last = _clause(before), before[-1][0].lower() if before else ""
    if clause == "from" and last == "from":
        return matching(prefix, catalog.measurement_names(database, policy))
    if not clause:
        return matching(prefix, KEYWORDS)
    fields, tags = catalog.keys(database, policy, measurement_of(line))
    if clause in ("where", "group"):
        return matching(prefix, tags)
    if clause == "select":
        inside = bool(before) and (before[-1][1] > 0 or last == "(")
        return matching(prefix, fields) if inside else matching(prefix, fields, tags, AFTER_SELECT)
    return matching(prefix, KEYWORDS)


def suffixes(catalog: Catalog, line: str, cursor: int | None = None, database: str | None = None, policy: str | None = None, seconds: float = 2.0) -> list[str]:
    """What a line editor puts behind the cursor: the rest of each candidate. A lookup that takes longer than `seconds`, or is cancelled, offers nothing."""
    pool = ThreadPoolExecutor(1)
    try:
        found = pool.submit(complete, catalog, line, cursor, database, policy).result(seconds)
    except (TimeoutError, CancelledError):
        return []
    finally:
        pool.shutdown(wait=False, cancel_futures=True)
    return [c[len(found.prefix) :] for c in found.candidates]


def _meta(catalog: Catalog, head: str, database: str | None, policy: str | None) -> Completion:
    words = head.split(" ")
    if len(words) == 1:
        return matching(words[0], META)
    command, prefix = words[0].lower(), words[-1]
    names = list(catalog.databases)
    if command in (":db", ":rps"):
        return matching(prefix, names)
    if command == ":use":
        scoped = [f"{d}.{p}" for d, db in catalog.databases.items() for p in db.policies]
        return matching(prefix, names, scoped)
    if command == ":rp" and database in catalog.databases:
        return matching(prefix, list(catalog.databases[database].policies))
    if command in (":schema", ":fields", ":tags"):
        return matching(prefix, catalog.measurement_names(database, policy))
    if command == ":refresh":
        return matching(prefix, ["schema"])
    if command in (":format", ":fmt"):
        return matching(prefix, ["auto", "chart", "json", "sparkline", "table"])
    return Completion(prefix)
