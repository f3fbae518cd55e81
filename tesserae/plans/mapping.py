"""The mapping language: text to an immutable plan. Parsing runs on the driver only."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from ..functions.kernel import VERBS, CompileError


@dataclass(frozen=True)
class Literal:
    value: Any
    kind: str = ""


@dataclass(frozen=True)
class Copy:
    path: str
    directives: tuple = ()


@dataclass(frozen=True)
class Call:
    verb: str
    args: tuple
    custom: bool = False


@dataclass(frozen=True)
class Build:
    """An object built from named expressions (no text form makes one; the API does)."""

    fields: tuple


@dataclass(frozen=True)
class Mapping:
    target: str
    expr: Any
    directives: tuple = ()
    modifiers: tuple = ()


@dataclass
class Segment:
    name: str
    mappings: list = field(default_factory=list)
    array: bool = False
    index: int | None = None
    each: str | None = None
    when: str | None = None
    condition: str | None = None
    discriminator: str | None = None
    discriminator_value: str | None = None
    number: int | None = None
    counter: str | None = None
    children: list = field(default_factory=list)


@dataclass
class Accumulator:
    initial: Any = None
    persist: bool = False


@dataclass
class Plan:
    header: dict = field(default_factory=dict)
    source: dict = field(default_factory=dict)
    target: dict = field(default_factory=dict)
    constants: dict = field(default_factory=dict)
    tables: dict = field(default_factory=dict)
    accumulators: dict = field(default_factory=dict)
    segments: list = field(default_factory=list)

    @property
    def source_format(self) -> str | None:
        return self.source.get("format") or (self.header.get("direction") or "").partition("->")[0].strip() or None

    @property
    def target_format(self) -> str:
        return self.target.get("format") or (self.header.get("direction") or "").partition("->")[2].strip() or "json"

    @property
    def passes(self) -> list[int]:
        """Pass numbers in order of running: those not declared run last, an explicit 0 first."""
        told = sorted({s.number for s in self.segments if s.number is not None})
        rest = any(s.number is None for s in self.segments)
        return told if 0 in told or not rest else [*told, 0]


MODIFIERS = ("required", "confidential", "deprecated")
#: Directives that take part of a raw record, and those of them with an operand (fixed values).
EXTRACT, EXTRACT_VALUE = ("pos", "len", "field", "trim"), ("pos", "len", "field")
_TOKEN = re.compile(r'"(?:\\.|[^"\\])*"?|%&?[^\s"]*|\S+')
_ESCAPE = {"n": "\n", "r": "\r", "t": "\t", '"': '"', "\\": "\\"}


def unescaped(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ESCAPE.get(m[1], m[0]), s)


def is_quoted(s: str) -> bool:
    return len(s) >= 2 and s[0] == s[-1] == '"'


def plain(s: str | None) -> str | None:
    s = s.strip() if s is not None else None
    return unescaped(s[1:-1]) if s and is_quoted(s) else s


def without_comment(s: str) -> str:
    """Up to the first semicolon outside quotes."""
    m = re.match(r'(?:[^;"\\]|\\.|"(?:\\.|[^"\\])*")*', s)
    return m[0].rstrip() if m and m.end() < len(s) and s[m.end()] == ";" else s


def literal(token: str) -> Literal:
    if is_quoted(token):
        return Literal(unescaped(token[1:-1]), "string")
    if token == "~" or not token:
        return Literal(None, "null")
    if token in ("true", "?true", "false", "?false"):
        return Literal(token.endswith("true"), "boolean")
    for pattern, kind, make in (
        (r"##(-?\d+)", "integer", int), (r"#\$(-?[\d.]+)(?::([A-Z]{3}))?", "currency", float), (r"#%(-?[\d.]+)", "percent", float), (r"#(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)", "number", float),
    ):
        m = re.fullmatch(pattern, token)
        if m:
            return Literal(make(m[1]), kind)
    return Literal(token, "string")


class _Reader:
    """Prefix notation over tokens: a verb takes as many operands as it has, a variadic one all up to a directive."""

    def __init__(self, tokens: list[str]):
        self.tokens, self.at = tokens, 0

    @property
    def done(self) -> bool:
        return self.at >= len(self.tokens)

    def peek(self) -> str:
        return self.tokens[self.at]

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    @property
    def at_directive(self) -> bool:
        return self.done or self.peek().startswith(":")

    def expression(self):
        if self.at_directive:
            return Literal(None, "null")
        token = self.peek()
        if token.startswith("%"):
            self.take()
            custom = token.startswith("%&")
            name = token[1 + custom :]
            verb = VERBS.get(name)
            most = verb.arity if verb is not None and not custom else None
            args = []
            while not self.at_directive and (most is None or len(args) < most):
                args.append(self.expression())
            return Call(name, tuple(args), custom)
        if token.startswith("@"):
            self.take()
            if token.startswith("@#"):
                raise CompileError(f"P001: no path in {token}")
            found = []
            while not self.done and self.peek()[1:] in EXTRACT and self.peek()[0] == ":":
                found.append(self.directive(only=EXTRACT_VALUE))
            return Copy(token[1:], tuple(found))
        return literal(self.take())

    def directive(self, only=None) -> tuple[str, Any]:
        name = self.take()[1:]
        takes = not self.at_directive and (only is None or name in only and self.peek()[0] not in "%@")
        if not takes:
            return name, True
        raw = self.take()
        if re.fullmatch(r"-?\d+", raw):
            return name, int(raw)
        if re.fullmatch(r"-?\d+\.\d+", raw):
            return name, float(raw)
        return name, plain(raw)

    def directives(self) -> list[tuple[str, Any]]:
        out = []
        while not self.done:
            if self.at_directive:
                out.append(self.directive())
            else:
                self.take()
        return out


def parse_expression(text: str | None):
    """An expression and the directives behind it."""
    text = (text or "").strip()
    if not text:
        return Literal(None, "null"), []
    if is_quoted(text) and text[1:2] in "@%":
        text = unescaped(text[1:-1])
    r = _Reader(_TOKEN.findall(text))
    return r.expression(), r.directives()


def _inner(expr):
    """Extraction directives anywhere within an expression."""
    if isinstance(expr, Copy):
        yield from expr.directives
    elif isinstance(expr, Call):
        for a in expr.args:
            yield from _inner(a)


def mapping(target: str, raw: str) -> Mapping:
    expr, found = parse_expression(raw)
    names = {n for n, _ in found}
    rest = [d for d in found if d[0] not in MODIFIERS]
    for d in _inner(expr):
        if d[0] not in names:
            names.add(d[0])
            rest.append(d)
    return Mapping(target, expr, tuple(rest), tuple(m for m in MODIFIERS if any(n == m for n, _ in found)))


#: Section keys that steer a segment, and the attribute they set (fixed values).
STEERING = {"_type": "discriminator_value", "_discriminator": "discriminator", "_discriminatorValue": "discriminator_value", "_when": "when", "_if": "condition", "_each": "each", "_loop": "each", "_from": "each", "_counter": "counter"}


def segment(path: str, assignments: list[tuple[str, str]]) -> Segment:
    name = re.sub(r"(\[\d*\])\s*:.*$", r"\1", path)
    m = re.fullmatch(r"(.+)\[(\d*)\]", name)
    out = Segment(m[1] if m else name, array=bool(m), index=int(m[2]) if m and m[2] else None)
    for key, raw in assignments:
        if key in STEERING:
            setattr(out, STEERING[key], plain(raw))
            out.array |= STEERING[key] == "each"
        elif key == "_pass":
            digits = re.search(r"-?\d+", plain(raw) or "")
            out.number = int(digits[0]) if digits else 0
        elif key == "_" or not key.startswith("_"):
            out.mappings.append(mapping(key, raw))
    return out


def parse(text: str) -> Plan:
    """The plan of a mapping text: sections in braces, ``key = expression`` lines, comments from a semicolon."""
    plan, order = Plan(), {}
    kind, current = "header", ""
    header: dict[str, str] = {}
    accumulators: list[tuple[str, str]] = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith(";"):
            continue
        section = re.fullmatch(r"\{(.*)\}", line)
        if section:
            current = section[1]
            table = re.fullmatch(r"\$\.?table\.([^\[]+)\[([^\]]+)\]", current)
            kind = {"$": "header", "$const": "const", "$constants": "const", "Constants": "const", "constants": "const", "$source": "source", "$target": "target", "$accumulator": "accumulator", "$accumulators": "accumulator"}.get(current, "segment")
            if table:
                kind, current = "table", table[1]
                plan.tables[current] = ([c.strip() for c in table[2].split(",")], [])
            elif kind == "segment":
                order.setdefault(current, [])
            continue
        if kind == "table":
            cells = re.findall(r'\s*("(?:\\.|[^"\\])*"|[^,]*)\s*(?:,|$)', line)[: len(plan.tables[current][0])]
            columns, rows = plan.tables[current]
            rows.append({c: literal(cells[i].strip()).value if i < len(cells) else None for i, c in enumerate(columns)})
            continue
        m = re.match(r"([^=]+?)\s*=\s*(.*)$", line)
        if not m:
            continue
        key, raw = m[1].strip(), without_comment(m[2].strip())
        if kind == "header":
            header[key] = raw
        elif kind == "source":
            plan.source[key] = plain(raw)
        elif kind == "target":
            plan.target[key] = plain(raw)
        elif kind == "const":
            plan.constants[key] = literal(raw).value
        elif kind == "accumulator":
            accumulators.append((key, raw))
        else:
            order[current].append((key, raw))
    _read_header(plan, header, accumulators)
    for key, raw in accumulators:
        if not key.endswith("._persist"):
            plan.accumulators[key] = Accumulator(literal(raw).value)
    for key, raw in accumulators:
        if key.endswith("._persist") and key.removesuffix("._persist") in plan.accumulators:
            plan.accumulators[key.removesuffix("._persist")].persist = plain(raw) in ("true", "?true")
    plan.segments = [segment(path, lines) for path, lines in order.items()]
    return plan


def _read_header(plan: Plan, header: dict[str, str], accumulators: list) -> None:
    rows: dict[str, dict[int, dict]] = {}
    for key, raw in header.items():
        first, _, rest = key.partition(".")
        if first in ("const", "constants"):
            plan.constants[rest] = literal(raw).value
        elif first in ("accumulator", "accumulators"):
            accumulators.append((rest, raw))
        elif first in ("table", "tables"):
            m = re.fullmatch(r"(.+?)\[(\d+)\]\.(.+)", rest)
            if m:
                rows.setdefault(m[1], {}).setdefault(int(m[2]), {})[m[3]] = literal(raw).value
        elif first == "source" and rest:
            plan.source[rest] = plain(raw)
        elif first == "target" and rest:
            plan.target[rest] = plain(raw)
        else:
            plan.header[key] = plain(raw)
    for name, own in rows.items():
        columns = list(dict.fromkeys(c for i in sorted(own) for c in own[i]))
        plan.tables[name] = (columns, [own[i] for i in sorted(own)])
