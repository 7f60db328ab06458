"""Text of the query language to a tree: scanner, statements and expressions. No Spark here."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class QueryError(Exception):
    """Base of what a query can raise."""


class ParseError(QueryError):
    def __init__(self, text: str, line: int, column: int) -> None:
        super().__init__(f"line {line}: parse error: {text}")
        self.line, self.column = line, column


class UnsupportedError(QueryError):
    """The query is well formed but asks for what this engine doesn't do."""


class RuntimeQueryError(QueryError):
    """Found while running; becomes the remark of a result."""


@dataclass
class Token:
    kind: str  # word, number, string, op, end
    text: str
    start: int
    end: int


_SCAN = re.compile(r"(?P<gap>\s+|//[^\n]*|/\*.*?\*/)|(?P<number>\d+(?:\.\d+)?|\.\d+)|(?P<word>[^\W\d]\w*)|(?P<op>->|::|>>|<<|!=|!~|==|<=|>=|&&|\|\||[\[\](){};:,.=~<>!+\-*/?])|(?P<quote>[\"'])", re.S)
#: What follows a backslash in a string.
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def scan(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _SCAN.match(text, at)
        if m is None:
            raise _error(text, at, f"unexpected character {text[at]!r}")
        if m.lastgroup == "quote":
            value, end = _string(text, at)
            out.append(Token("string", value, at, end))
            at = end
            continue
        if m.lastgroup != "gap":
            out.append(Token(m.lastgroup, m[0], at, m.end()))
        at = m.end()
    out.append(Token("end", "", len(text), len(text)))
    return out


def _string(text: str, at: int) -> tuple[str, int]:
    quote, i, out = text[at], at + 1, []
    while i < len(text):
        c = text[i]
        if c == quote:
            return "".join(out), i + 1
        if c == "\n":
            break
        if c == "\\" and i + 1 < len(text):
            n = text[i + 1]
            if n == "u" and re.fullmatch(r"[0-9a-fA-F]{4}", text[i + 2 : i + 6]):
                out.append(chr(int(text[i + 2 : i + 6], 16)))
                i += 6
                continue
            out.append(_ESCAPES.get(n, n))
            i += 2
            continue
        out.append(c)
        i += 1
    raise _error(text, at, "unterminated string")


def _error(text: str, at: int, said: str) -> ParseError:
    return ParseError(said, text.count("\n", 0, at) + 1, at - text.rfind("\n", 0, at))


# ---- statements -------------------------------------------------------------------------------------------------


@dataclass
class Settings:
    out: str = "xml"
    csv_fields: list[str] = field(default_factory=list)
    csv_header: bool = True
    csv_separator: str = "\t"
    timeout: int = 180
    maxsize: int = 512 << 20
    bbox: tuple[float, float, float, float] | None = None
    date: str | None = None
    diff: tuple[str, str | None] | None = None
    adiff: tuple[str, str | None] | None = None


@dataclass
class Filter:
    kind: str
    args: dict


@dataclass
class Query:
    type: str
    sets: list[str]
    filters: list[Filter]
    into: str = "_"


@dataclass
class Recurse:
    op: str
    source: str = "_"
    into: str = "_"


@dataclass
class Item:
    source: str
    into: str = "_"


@dataclass
class Union:
    body: list
    into: str = "_"


@dataclass
class Difference:
    left: list
    right: list
    into: str = "_"


@dataclass
class Out:
    source: str = "_"
    verbosity: str = "body"
    geometry: str | None = None
    bbox: tuple | None = None
    order: str = "asc"
    limit: int | None = None


@dataclass
class Foreach:
    source: str
    into: str
    body: list


@dataclass
class If:
    condition: object
    then: list
    otherwise: list


@dataclass
class Retro:
    time: object
    body: list


@dataclass
class Timeline:
    type: str
    id: int
    version: int | None
    into: str = "_"


@dataclass
class IsIn:
    source: str = "_"
    point: tuple[float, float] | None = None
    into: str = "_"


@dataclass
class MapToArea:
    source: str = "_"
    into: str = "_"


@dataclass
class Unsupported:
    name: str


@dataclass
class Program:
    settings: Settings
    body: list


#: Element kinds that each query keyword covers.
TYPES = {"node": "n", "way": "w", "rel": "r", "relation": "r", "nwr": "nwr", "nw": "nw", "nr": "nr", "wr": "wr", "area": "a", "derived": "d"}
_NOT_DONE = frozenset("for complete compare make convert local".split())
_VERBOSITY = frozenset("ids skel body tags meta noids count".split())


class Parser:
    def __init__(self, text: str) -> None:
        self.text, self.tokens, self.i = text, scan(text), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def fail(self, said: str) -> ParseError:
        return _error(self.text, self.now.start, said)

    def at(self, *ops: str) -> bool:
        return self.now.kind in ("op", "word") and self.now.text in ops

    def take(self, *ops: str) -> bool:
        if self.at(*ops):
            self.i += 1
            return True
        return False

    def need(self, op: str) -> None:
        if not self.take(op):
            raise self.fail(f"expected {op!r}, found {self.now.text!r}")

    def word(self) -> str:
        if self.now.kind != "word":
            raise self.fail(f"expected a name, found {self.now.text!r}")
        self.i += 1
        return self.tokens[self.i - 1].text

    def bare(self) -> str:
        """A string, or names, numbers, ``:``, ``.`` and ``-`` that touch."""
        if self.now.kind == "string":
            self.i += 1
            return self.tokens[self.i - 1].text
        first = self.now
        while (self.now.kind in ("word", "number") or self.at(":", ".", "-", "::")) and (self.now is first or self.now.start == self.tokens[self.i - 1].end):
            self.i += 1
        if self.now is first:
            raise self.fail(f"expected a value, found {self.now.text!r}")
        return self.text[first.start : self.tokens[self.i - 1].end]

    def number(self) -> float:
        sign = -1 if self.take("-") else 1
        if self.now.kind != "number":
            raise self.fail(f"expected a number, found {self.now.text!r}")
        self.i += 1
        return sign * float(self.tokens[self.i - 1].text)

    def integer(self) -> int:
        n = self.number()
        if n != int(n):
            raise self.fail("expected a whole number")
        return int(n)

    def into(self) -> str:
        if self.take("->"):
            self.need(".")
            return self.word()
        return "_"

    def program(self) -> Program:
        settings = Settings()
        if self.at("["):
            while self.take("["):
                self.setting(settings)
            self.need(";")
        body = self.statements("")
        if self.now.kind != "end":
            raise self.fail(f"unexpected {self.now.text!r}")
        return Program(settings, body)

    def setting(self, s: Settings) -> None:
        name = self.word()
        self.need(":")
        if name == "out":
            s.out = self.word()
            if s.out not in ("json", "xml", "csv"):
                raise UnsupportedError(f"output format {s.out}")
            if s.out == "csv":
                self.csv(s)
        elif name in ("timeout", "maxsize"):
            setattr(s, name, self.integer())
        elif name == "bbox":
            s.bbox = tuple(self.numbers(4))
        elif name == "date":
            s.date = self.bare()
        elif name in ("diff", "adiff"):
            first = self.bare()
            setattr(s, name, (first, self.bare() if self.take(",") else None))
        else:
            raise self.fail(f"unknown setting {name!r}")
        self.need("]")

    def csv(self, s: Settings) -> None:
        self.need("(")
        while True:
            s.csv_fields.append(("::" + self.word()) if self.take("::") else self.bare())
            if not self.take(","):
                break
        if self.take(";"):
            s.csv_header = self.word() == "true"
            if self.take(";"):
                s.csv_separator = self.bare()
        self.need(")")

    def numbers(self, n: int) -> list[float]:
        out = [self.number()]
        while self.take(","):
            out.append(self.number())
        if len(out) != n:
            raise self.fail(f"expected {n} numbers")
        return out

    def statements(self, until: str) -> list:
        out = []
        while self.now.kind != "end" and not (until and self.at(until)):
            if self.take(";"):
                continue
            out.append(self.statement())
            if self.tokens[self.i - 1].text != "}":
                if until and self.at(until):
                    break
                self.need(";")
        return out

    def block(self) -> list:
        self.need("{")
        body = self.statements("}")
        self.need("}")
        return body

    def statement(self):  # noqa: ANN201, C901, PLR0911
        if self.take("("):
            return self.group()
        if self.at(">", ">>", "<", "<<"):
            return self.recursion("_")
        if self.take("."):
            source = self.word()
            if self.at(">", ">>", "<", "<<"):
                return self.recursion(source)
            for name, make in (("out", self.out), ("is_in", self.is_in), ("map_to_area", self.map_to_area)):
                if self.take(name):
                    return make(source)
            return Item(source, self.into())
        name = self.now.text
        if self.now.kind != "word":
            raise self.fail(f"unexpected {name!r}")
        if name in _NOT_DONE:
            raise UnsupportedError(f"statement {name!r}")
        self.i += 1
        if name in TYPES:
            return self.query(name)
        if name in ("out", "is_in", "map_to_area"):
            return getattr(self, name)("_")
        if name == "foreach":
            source = "_"
            if self.take("."):
                source = self.word()
            into = self.into()
            return Foreach(source, into, self.block())
        if name == "if":
            self.need("(")
            condition = Expressions(self).ternary()
            self.need(")")
            then = self.block()
            return If(condition, then, self.block() if self.take("else") else [])
        if name == "retro":
            self.need("(")
            time = Expressions(self).ternary()
            self.need(")")
            return Retro(time, self.block())
        if name == "timeline":
            self.need("(")
            kind = self.bare()
            self.need(",")
            number = self.integer()
            version = self.integer() if self.take(",") else None
            self.need(")")
            return Timeline({"relation": "relation", "rel": "relation"}.get(kind, kind), number, version, self.into())
        self.i -= 1
        raise self.fail(f"unexpected {name!r}")

    def recursion(self, source: str) -> Recurse:
        op = self.now.text
        self.i += 1
        return Recurse(op, source, self.into())

    def group(self):  # noqa: ANN201
        left: list = []
        right: list | None = None
        while not self.take(")"):
            if self.take(";"):
                continue
            if self.take("-"):
                if right is not None or not left:
                    raise self.fail("misplaced '-'")
                right = []
                continue
            (left if right is None else right).append(self.statement())
            if not self.at(")") and self.tokens[self.i - 1].text != "}":
                self.need(";")
        if right is None:
            return Union(left, self.into())
        if not right:
            raise self.fail("nothing after '-'")
        return Difference(left, right, self.into())

    def query(self, name: str) -> Query:
        sets, filters = [], []
        while True:
            if self.take("."):
                sets.append(self.word())
            elif self.take("["):
                filters.append(self.tag_filter())
            elif self.take("("):
                filters.append(self.paren_filter())
            else:
                break
        return Query(name, sets, filters, self.into())

    def tag_filter(self) -> Filter:
        if self.take("!"):
            key = self.bare()
            self.need("]")
            return Filter("absent", {"key": key})
        if self.take("~"):
            key = self.bare()
            self.need("~")
            args = {"key": key, "value": self.bare(), "fold": self.fold()}
            self.need("]")
            return Filter("key_match", args)
        key = self.bare()
        for op, kind in (("=", "equals"), ("!=", "differs"), ("~", "match"), ("!~", "no_match")):
            if self.take(op):
                args = {"key": key, "value": self.bare()}
                if "match" in kind:
                    args["fold"] = self.fold()
                self.need("]")
                return Filter(kind, args)
        self.need("]")
        return Filter("present", {"key": key})

    def fold(self) -> bool:
        if self.take(","):
            if self.word() != "i":
                raise self.fail("only the flag i is known")
            return True
        return False

    def paren_filter(self) -> Filter:  # noqa: C901, PLR0911, PLR0912
        if self.now.kind == "number" or self.at("-"):
            values = [self.number()]
            while self.take(","):
                values.append(self.number())
            self.need(")")
            if len(values) == 4:
                return Filter("bbox", {"bbox": tuple(values)})
            return Filter("ids", {"ids": [int(v) for v in values]})
        name = self.word()
        if name in ("w", "r", "bn", "bw", "br"):
            args: dict = {"edge": name, "set": "_", "role": None}
            if self.take("."):
                args["set"] = self.word()
            if self.take(":"):
                args["role"] = "" if self.at(")") else self.bare()
            out = Filter("recurse", args)
        elif name == "id":
            self.need(":")
            ids = [self.integer()]
            while self.take(","):
                ids.append(self.integer())
            out = Filter("ids", {"ids": ids})
        elif name == "around":
            source = self.word() if self.take(".") else "_"
            self.need(":")
            radius = self.number()
            points = []
            while self.take(","):
                lat = self.number()
                self.need(",")
                points.append((lat, self.number()))
            out = Filter("around", {"set": source, "radius": radius, "points": points})
        elif name == "poly":
            self.need(":")
            try:
                values = [float(x) for x in self.bare().split()]
            except ValueError:
                raise self.fail("poly needs numbers") from None
            if len(values) % 2 or len(values) < 6:
                raise self.fail("poly needs at least three points")
            out = Filter("poly", {"ring": list(zip(values[::2], values[1::2], strict=True))})
        elif name in ("area", "pivot"):
            args = {"set": "_", "id": None}
            if self.take("."):
                args["set"] = self.word()
            elif name == "area" and self.take(":"):
                args["id"] = self.integer()
            out = Filter(name, args)
        elif name in ("newer", "changed"):
            self.need(":")
            args = {"since": self.bare()}
            args["until"] = self.bare() if name == "changed" and self.take(",") else None
            out = Filter(name, args)
        elif name in ("user", "uid"):
            self.need(":")
            read = self.bare if name == "user" else self.integer
            values = [read()]
            while self.take(","):
                values.append(read())
            out = Filter(name, {"values": values})
        elif name == "if":
            self.need(":")
            out = Filter("if", {"expression": Expressions(self).ternary()})
        else:
            raise self.fail(f"unknown filter {name!r}")
        self.need(")")
        return out

    def out(self, source: str) -> Out:
        o = Out(source)
        while not self.at(";", "}", ")") and self.now.kind != "end":
            if self.now.kind == "number":
                o.limit = self.integer()
                continue
            name = self.word()
            if name in _VERBOSITY:
                o.verbosity = name
            elif name in ("geom", "bb", "center"):
                o.geometry = name
                if name == "geom" and self.take("("):
                    o.bbox = tuple(self.numbers(4))
                    self.need(")")
            elif name in ("asc", "qt"):
                o.order = name
            else:
                raise self.fail(f"unknown word {name!r} after out")
        return o

    def is_in(self, source: str) -> IsIn:
        point = None
        if self.take("("):
            point = tuple(self.numbers(2))
            self.need(")")
        return IsIn(source, point, self.into())

    def map_to_area(self, source: str) -> MapToArea:
        return MapToArea(source, self.into())


# ---- expressions ------------------------------------------------------------------------------------------------


@dataclass
class Literal:
    value: object


@dataclass
class Tag:
    key: object


@dataclass
class Call:
    name: str
    args: list
    source: str = "_"


@dataclass
class Binary:
    op: str
    left: object
    right: object


@dataclass
class Unary:
    op: str
    value: object


@dataclass
class Ternary:
    condition: object
    then: object
    otherwise: object


#: Functions of an element, and of a set, with the numbers of their arguments.
ELEMENT_CALLS = {"id": 0, "type": 0, "version": 0, "timestamp": 0, "changeset": 0, "uid": 0, "user": 0, "count_tags": 0, "count_members": 0, "count_distinct_members": 0, "count_by_role": 1, "is_closed": 0, "length": 0, "lat": 0, "lon": 0, "is_tag": 1, "number": 1, "is_number": 1}
SET_CALLS = {"count": 1, "u": 1, "min": 1, "max": 1, "sum": 1, "set": 1}
_LEVELS = (("||",), ("&&",), ("==", "!="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "/"))


class Expressions:
    """Precedence climbing over the tokens of a parser."""

    def __init__(self, parser: Parser) -> None:
        self.p = parser

    def ternary(self):  # noqa: ANN201
        condition = self.binary(0)
        if self.p.take("?"):
            then = self.ternary()
            self.p.need(":")
            return Ternary(condition, then, self.ternary())
        return condition

    def binary(self, level: int):  # noqa: ANN201
        if level == len(_LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while self.p.at(*_LEVELS[level]) and self.p.now.kind == "op":
            op = self.p.now.text
            self.p.i += 1
            left = Binary(op, left, self.binary(level + 1))
        return left

    def unary(self):  # noqa: ANN201
        if self.p.at("!", "-"):
            op = self.p.now.text
            self.p.i += 1
            return Unary(op, self.unary())
        return self.primary()

    def primary(self):  # noqa: ANN201, C901
        p = self.p
        if p.take("("):
            out = self.ternary()
            p.need(")")
            return out
        if p.now.kind == "number":
            text = p.now.text
            p.i += 1
            return Literal(float(text) if "." in text else int(text))
        if p.now.kind == "string":
            p.i += 1
            return Literal(p.tokens[p.i - 1].text)
        source = "_"
        if p.take("."):
            source = p.word()
            p.need(".")
        name = p.word()
        if name == "t" and p.take("["):
            key = self.ternary()
            p.need("]")
            return Tag(key)
        if name not in ELEMENT_CALLS and name not in SET_CALLS:
            raise p.fail(f"unknown function {name!r}")
        p.need("(")
        args = []
        if name == "count":
            args.append(Literal(p.word()))
            if args[0].value not in ("nodes", "ways", "relations", "areas", "nwr", "nw", "nr", "wr"):
                raise p.fail("count needs a kind of element")
        else:
            while not p.at(")"):
                args.append(self.ternary())
                if not p.take(","):
                    break
        p.need(")")
        if len(args) != (ELEMENT_CALLS | SET_CALLS)[name]:
            raise p.fail(f"{name} takes {(ELEMENT_CALLS | SET_CALLS)[name]} arguments")
        return Call(name, args, source)


def parse(text: str) -> Program:
    return Parser(text).program()


def parse_expression(text: str):  # noqa: ANN201
    p = Parser(text)
    out = Expressions(p).ternary()
    if p.now.kind != "end":
        raise p.fail(f"unexpected {p.now.text!r}")
    return out
