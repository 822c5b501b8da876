"""A recursive-descent parser of the query language into plain data."""

from __future__ import annotations

from dataclasses import dataclass, field

from .lexer import QueryError, Token, tokens


@dataclass(frozen=True)
class Name:
    value: str


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class Duration:
    ns: int


@dataclass(frozen=True)
class Regex:
    value: str


@dataclass(frozen=True)
class Star:
    pass


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Source:
    """A measurement by up to three names, all whose names match a pattern, or a subquery."""

    names: tuple[str, ...] = ()
    query: object = None
    pattern: str | None = None


@dataclass
class Select:
    fields: list[tuple[object, str | None]]
    source: Source | None = None
    where: object = None
    every_ns: int | None = None
    offset_ns: int = 0
    tags: list[str] = field(default_factory=list)
    all_tags: bool = False
    fill: object = None
    descending: bool = False
    limit: int | None = None
    offset: int = 0
    slimit: int | None = None
    soffset: int = 0
    tz: str | None = None
    into: Source | None = None


@dataclass
class Show:
    what: str
    source: Source | None = None
    database: str | None = None
    keys: tuple[str, ...] = ()


@dataclass
class Explain:
    query: Select


@dataclass
class Create:
    database: str


@dataclass
class Drop:
    what: str
    name: str


_LEVELS = [("or",), ("and",), ("=", "!=", "<>", "<", "<=", ">", ">=", "=~", "!~"), ("+", "-"), ("*", "/", "%")]


class Parser:
    def __init__(self, text: str):
        self.toks, self.i = tokens(text), 0

    def peek(self, ahead: int = 0) -> Token | None:
        return self.toks[self.i + ahead] if self.i + ahead < len(self.toks) else None

    def word(self, *words: str) -> bool:
        """Whether the next tokens are these words; if so they are passed."""
        for k, w in enumerate(words):
            t = self.peek(k)
            if t is None or t.kind != "word" or t.value.lower() != w:
                return False
        self.i += len(words)
        return True

    def mark(self, m: str) -> bool:
        t = self.peek()
        if t is not None and t.kind == "mark" and t.value == m:
            self.i += 1
            return True
        return False

    def need(self, ok: bool, what: str) -> None:
        if not ok:
            t = self.peek()
            raise QueryError(f"expected {what}" + (f" at {t.at}, found {t.value!r}" if t else " at the end"))

    def take(self, *kinds: str) -> object:
        t = self.peek()
        self.need(t is not None and t.kind in kinds, " or ".join(kinds))
        self.i += 1
        return t.value

    def name(self) -> str:
        return str(self.take("word", "name"))

    def statement(self):
        if self.word("explain"):
            self.word("analyze")
            out = Explain(self.select())
        elif self.word("show"):
            out = self.show()
        elif self.word("create", "database"):
            out = Create(self.name())
        elif self.word("drop", "database"):
            out = Drop("database", self.name())
        elif self.word("drop", "measurement"):
            out = Drop("measurement", self.name())
        else:
            out = self.select()
        self.mark(";")
        self.need(self.peek() is None, "the end")
        return out

    def show(self) -> Show:
        names = {("databases",): "databases", ("retention", "policies"): "retention policies", ("measurements",): "measurements", ("field", "keys"): "field keys", ("tag", "keys"): "tag keys", ("tag", "values"): "tag values", ("series", "cardinality"): "series cardinality", ("series",): "series"}
        for words, what in names.items():
            if self.word(*words):
                out = Show(what)
                break
        else:
            self.need(False, "what to show")
        while self.peek() is not None and self.peek().value != ";":
            if self.word("on"):
                out.database = self.name()
            elif self.word("from"):
                out.source = self.source()
            elif self.word("with", "key"):
                if self.word("in"):
                    self.need(self.mark("("), "(")
                    out.keys = (self.name(),)
                    while self.mark(","):
                        out.keys += (self.name(),)
                    self.need(self.mark(")"), ")")
                else:
                    self.need(self.mark("="), "=")
                    out.keys = (self.name(),)
            else:
                self.need(False, "ON, FROM or WITH KEY")
        self.need(out.what != "tag values" or bool(out.keys), "WITH KEY")
        return out

    def select(self) -> Select:
        self.need(self.word("select"), "SELECT")
        q = Select([self.column()])
        while self.mark(","):
            q.fields.append(self.column())
        if self.word("into"):
            q.into = self.source()
            self.need(bool(q.into.names), "a measurement")
        if self.word("from"):
            q.source = self.source()
        if self.word("where"):
            q.where = self.expression()
        if self.word("group", "by"):
            self.grouping(q)
        if self.word("fill"):
            self.need(self.mark("("), "(")
            t = self.peek()
            self.i += 1
            negative = t is not None and t.value == "-"
            value = self.take("number") if negative else t.value if t else None
            q.fill = -value if negative else value.lower() if isinstance(value, str) else value
            self.need(q.fill in ("null", "none", "previous", "linear") or isinstance(q.fill, (int, float)), "a fill option")
            self.need(self.mark(")"), ")")
        if self.word("order", "by"):
            self.need(self.name().lower() == "time", "time")
            q.descending = self.word("desc")
            self.word("asc")
        for key in ("limit", "offset", "slimit", "soffset"):
            if self.word(key):
                setattr(q, key, int(self.take("number")))
        if self.word("tz"):
            self.need(self.mark("("), "(")
            q.tz = str(self.take("text"))
            self.need(self.mark(")"), ")")
        return q

    def column(self):
        e = self.expression()
        return e, self.name() if self.word("as") else None

    def source(self) -> Source:
        if self.mark("("):
            q = self.select()
            self.need(self.mark(")"), ")")
            return Source(query=q)
        if self.peek() is not None and self.peek().kind == "regex":
            return Source(pattern=str(self.take("regex")))
        names = [self.name()]
        while self.mark("."):
            if self.mark("."):
                names.append("")
            names.append(self.name())
        self.need(len(names) <= 3, "at most three names")
        return Source(tuple(names))

    def grouping(self, q: Select) -> None:
        while True:
            if self.mark("*"):
                q.all_tags = True
            elif self.peek() is not None and str(self.peek().value).lower() == "time" and self.peek(1) is not None and self.peek(1).value == "(":
                self.i += 2
                q.every_ns = int(self.take("duration"))
                if self.mark(","):
                    sign = -1 if self.mark("-") else 1
                    q.offset_ns = sign * int(self.take("duration"))
                self.need(self.mark(")"), ")")
            else:
                q.tags.append(self.name())
            if not self.mark(","):
                return

    def expression(self, level: int = 0):
        if level == len(_LEVELS):
            return self.atom()
        left = self.expression(level + 1)
        while (t := self.peek()) is not None and t.kind in ("mark", "word") and str(t.value).lower() in _LEVELS[level]:
            self.i += 1
            left = Binary(str(t.value).lower(), left, self.expression(level + 1))
        return left

    def atom(self):
        t = self.peek()
        self.need(t is not None, "an expression")
        self.i += 1
        if t.kind == "number":
            return Literal(t.value)
        if t.kind == "text":
            return Literal(t.value)
        if t.kind == "duration":
            return Duration(t.value)
        if t.kind == "regex":
            return Regex(t.value)
        if t.value == "*":
            return Star()
        if t.value == "-":
            return Binary("-", Literal(0), self.atom())
        if t.value == "(":
            e = self.expression()
            self.need(self.mark(")"), ")")
            return e
        self.i -= 1
        self.need(t.kind in ("word", "name"), "an expression")
        name = self.name()
        if t.kind == "word" and self.mark("("):
            args = []
            while not self.mark(")"):
                args.append(self.expression())
                self.need(self.mark(",") or (self.peek() is not None and self.peek().value == ")"), ", or )")
            return Call(name.lower(), tuple(args))
        if t.kind == "word" and name.lower() in ("true", "false"):
            return Literal(name.lower() == "true")
        if self.mark("::"):
            self.name()
        return Name(name)


def parse(text: str):
    return Parser(text).statement()
