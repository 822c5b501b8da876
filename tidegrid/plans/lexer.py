"""Tokens of the query language, statement splitting, and assembly of statements from lines."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Nanoseconds of the units of duration literals.
UNITS = {"ns": 1, "u": 1_000, "µ": 1_000, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9, "w": 7 * 86400 * 10**9}


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class Token:
    kind: str  # word, name (quoted), text, number, duration, regex, mark
    value: object
    at: int


_SKIP = re.compile(r"(?:\s+|--[^\n]*|//[^\n]*|/\*.*?\*/)+", re.S)
_DURATION = re.compile(r"(?:\d+(?:ns|ms|µ|[usmhdw]))+(?![\w.])")
_NUMBER = re.compile(r"\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?")
_WORD = re.compile(r"[^\W\d]\w*")
_MARK = re.compile(r"=~|!~|<>|!=|<=|>=|\|>|::|[-+*/%=<>(),.;:\[\]{}|]")


def _quoted(text: str, at: int) -> tuple[str, int]:
    """The content of a quoted token that begins at `at`, and where it ends."""
    quote, i, out = text[at], at + 1, []
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            out.append(text[i + 1] if text[i + 1] in "\\'\"`/" else c + text[i + 1])
            i += 2
        elif c == quote:
            return "".join(out), i + 1
        else:
            out.append(c)
            i += 1
    raise QueryError(f"unterminated quote at {at}")


def duration_ns(text: str) -> int:
    return sum(int(n) * UNITS[u] for n, u in re.findall(r"(\d+)(ns|ms|µ|[usmhdw])", text))


def tokens(text: str) -> list[Token]:
    out: list[Token] = []
    i = 0
    while True:
        if m := _SKIP.match(text, i):
            i = m.end()
        if i >= len(text):
            return out
        c = text[i]
        if c in "'\"`":
            value, end = _quoted(text, i)
            out.append(Token("text" if c == "'" else "name", value, i))
        elif c == "/" and out and (out[-1].value in ("=~", "!~") or (out[-1].kind == "word" and out[-1].value.lower() == "from")):
            value, end = _quoted(text, i)
            out.append(Token("regex", value, i))
        elif m := _DURATION.match(text, i):
            out.append(Token("duration", duration_ns(m[0]), i))
            end = m.end()
        elif m := _NUMBER.match(text, i):
            out.append(Token("number", float(m[0]) if re.search(r"[.eE]", m[0]) else int(m[0]), i))
            end = m.end()
        elif m := _WORD.match(text, i):
            out.append(Token("word", m[0], i))
            end = m.end()
        elif m := _MARK.match(text, i):
            out.append(Token("mark", m[0], i))
            end = m.end()
        else:
            raise QueryError(f"unexpected {c!r} at {i}")
        i = end


def statements(text: str) -> list[str]:
    """The statements between semicolons outside quotes, brackets and comments; blank ones left out."""
    cuts = [t.at for t in tokens(text) if t.value == ";" and t.kind == "mark"]
    parts = [text[a:b] for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(text)])]
    return [p.strip() for p in parts if tokens(p)]


# Dialect and kind.


def dialect(text: str) -> str:
    return "flux" if "|>" in text or re.search(r"from\s*\(\s*bucket\s*:", text) else "influxql"


def kind(text: str) -> str:
    s = text.strip().lower()
    if s.startswith(":"):
        return "schema" if s.startswith(":schema") else "explain" if s.startswith(":explain") else "meta"
    return "show" if s.startswith("show ") else "explain" if s.startswith("explain ") else "select"


@dataclass
class _Scan:
    """Lexical state at the end of a text."""

    quote: str = ""
    depth: int = 0
    comment: bool = False
    ends_statement: bool = False


def _scan(text: str) -> _Scan:
    s, i, last = _Scan(), 0, ""
    while i < len(text):
        c, two = text[i], text[i : i + 2]
        if s.comment:
            if two == "*/":
                s.comment, i = False, i + 1
        elif s.quote:
            if c == "\\":
                i += 1
            elif c == s.quote:
                s.quote, last = "", c
        elif two in ("--", "//") and not (c == "/" and (last == "~" or text[:i].rstrip().lower().endswith("from"))):
            i = text.find("\n", i)
            if i < 0:
                break
            continue
        elif two == "/*":
            s.comment, i = True, i + 1
        elif c in "'\"`" or (c == "/" and (last == "~" or text[:i].rstrip().lower().endswith("from"))):
            s.quote, s.ends_statement = c, False
        elif not c.isspace():
            s.depth += (c in "([{") - (c in ")]}")
            s.ends_statement = c == ";" and s.depth == 0
            last = c
        i += 1
    return s


# Endings after which a statement goes on.
CONTINUES = ("and", "or", ",", "|>", "|", "=", "<", ">", "+", "-", "*", "/", "%", "(")


class StatementBuffer:
    """Joins lines into statements: a trailing backslash, open quotes or brackets, a SELECT without FROM, or an ending that wants more go on; once several lines are joined, only a final semicolon ends them."""

    def __init__(self):
        self.lines: list[str] = []

    @property
    def active(self) -> bool:
        return bool(self.lines)

    def reset(self) -> None:
        self.lines = []

    def add(self, line: str) -> str | None:
        """The finished statement, or None if it goes on."""
        slash = line.rstrip().endswith("\\")
        was = self.active
        self.lines.append(line.rstrip()[:-1].rstrip() if slash else line)
        text = "\n".join(self.lines).strip()
        if not text:
            self.reset()
            return None
        s = _scan(text)
        done = s.ends_statement and not s.quote and not s.comment
        if slash or s.quote or s.comment or s.depth > 0 or (not done and (was or self._wants_more(text))):
            return None
        self.reset()
        return text[:-1].rstrip() if done else text

    @staticmethod
    def _wants_more(text: str) -> bool:
        low = text.lower()
        if low.startswith(":"):
            return False
        words = re.findall(r"\w+", low)
        if words[:1] == ["select"] and "from" not in words and not re.match(r"select\s+\w+\(\s*\)$", low):
            return True
        return low.endswith(CONTINUES)
