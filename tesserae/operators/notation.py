"""The typed document notation: text to assignments (path, type, value) and back. Runs per document, in Arrow batches.

A document is lines ``path = value`` under headers ``{a.b}``, relative headers ``{.c}``, tables ``{rows[] : x, y}`` and
metadata ``{$}``; ``---`` begins the next document of a chain. Errors are rows, never exceptions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Codes and texts of parse errors that are raised (fixed values).
ERRORS = {
    "P001": "Unexpected character", "P002": "Strings must be quoted", "P003": "Invalid array index", "P004": "Unterminated string", "P005": "Invalid escape sequence", "P006": "Invalid type prefix",
    "P007": "Duplicate path assignment", "P008": "Invalid header syntax", "P009": "Invalid directive", "P010": "Maximum depth exceeded", "P011": "Maximum document size exceeded", "P013": "Non-contiguous array indices",
    "P015": "Array index out of range",
}
MOST_BYTES, MOST_DEPTH, MOST_INDEX = 10 << 20, 64, 10_000
MODIFIERS = {"!": "required", "*": "confidential", "-": "deprecated"}
_SIGN = {v: k for k, v in MODIFIERS.items()}


class NotationError(ValueError):
    def __init__(self, code: str, line: int, detail: str = ""):
        super().__init__(f"{code}: {ERRORS[code]}" + (f" ({detail})" if detail else ""))
        self.code, self.line = code, line


@dataclass
class Assignment:
    path: str
    type: str
    text: str | None
    number: float | None = None
    mods: tuple = ()
    directives: tuple = ()


@dataclass
class Document:
    assignments: list = field(default_factory=list)
    directives: list = field(default_factory=list)

    def get(self, path: str):
        return next((a for a in self.assignments if a.path == path), None)


_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", '"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "0": "\0"}
_STRING = re.compile(r'"((?:[^"\\]|\\.)*)"', re.S)
_LONG = re.compile(r'"""(.*?)"""', re.S)


def unescape(s: str, line: int) -> str:
    def one(m):
        sign = m[1]
        if sign[0] == "u":
            return chr(int(sign[1:], 16))
        if sign not in _ESCAPES:
            raise NotationError("P005", line, sign)
        return _ESCAPES[sign]

    return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", one, s, flags=re.S)


#: What a bare token is, in order of trial: pattern, type, group of the text, whether it is a number (fixed values).
TOKENS = (
    (r"~", "null", None, False), (r"\??(true|false)", "boolean", 1, False), (r"##([+-]?\d+)", "integer", 1, True), (r"#\$([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)(?::[A-Za-z]{3})?", "currency", 1, True),
    (r"#%([+-]?\d+(?:\.\d+)?)", "percent", 1, True), (r"#([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)", "number", 1, True), (r"@([^\s;]*)", "reference", 1, False), (r"\^([^\s;]*)", "binary", 1, False),
    (r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])T\S+", "timestamp", 0, False), (r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])", "date", 0, False), (r"T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?", "time", 0, False),
    (r"P(?=[\dT])[\dYMWDTHS.]+", "duration", 0, False), (r"%(\S.*)", "verb", 1, False), (r"\[\]", "array", 0, False), (r"\{\}", "object", 0, False),
)
_TOKENS = [(re.compile(p), *rest) for p, *rest in TOKENS]


def read_value(s: str, line: int):
    """(type, text, number, mods, rest) of a value and what stands behind it."""
    mods = []
    while s[:1] in MODIFIERS and s[:1] and not re.match(r"-\d", s):
        mods.append(MODIFIERS[s[0]])
        s = s[1:].lstrip()
    m = _LONG.match(s)
    if m:
        return "string", m[1], None, tuple(mods), s[m.end() :]
    if s.startswith('"'):
        m = _STRING.match(s)
        if not m:
            raise NotationError("P004", line)
        return "string", unescape(m[1], line), None, tuple(mods), s[m.end() :]
    token = re.match(r"%[^;]*|[^\s;]*", s)[0].rstrip()
    for pattern, kind, group, numeric in _TOKENS:
        m = pattern.fullmatch(token)
        if m:
            shown = None if group is None else m[group]
            if kind == "currency" and ":" in token:
                shown = token[2:]
            return kind, shown, float(m[group]) if numeric else None, tuple(mods), s[len(token) :]
    if token[:1] == "#" or token[:1] == "?":
        raise NotationError("P006", line, token)
    raise NotationError("P002", line, token)


def read_directives(s: str, line: int) -> tuple:
    out = []
    s = s.strip()
    while s and not s.startswith(";"):
        m = re.match(r':([A-Za-z_][\w-]*)(?:\s+("(?:[^"\\]|\\.)*"|[^\s:;]+))?\s*', s)
        if not m:
            raise NotationError("P009" if s.startswith(":") else "P001", line, s)
        out.append((m[1], m[2].strip('"') if m[2] else None))
        s = s[m.end() :]
    return tuple(out)


class _State:
    def __init__(self):
        self.begin()

    def begin(self):
        self.doc, self.context, self.absolute, self.meta, self.table, self.seen, self.indices = Document(), "", "", False, None, set(), {}

    def full(self, path: str) -> str:
        if self.meta:
            return "$." + (f"{self.context}.{path}" if self.context else path)
        if path.startswith("&") or not self.context:
            return path
        return f"{self.context}{path}" if path.startswith("[") else f"{self.context}.{path}"

    def add(self, path: str, value, directives, line: int):
        kind, text, number, mods = value
        if path in self.seen:
            raise NotationError("P007", line, path)
        if path.count(".") + path.count("[") > MOST_DEPTH:
            raise NotationError("P010", line)
        for m in re.finditer(r"\[([^\]]*)\]", path):
            if not re.fullmatch(r"\d+", m[1]):
                raise NotationError("P003", line, m[1])
            if int(m[1]) > MOST_INDEX:
                raise NotationError("P015", line, m[1])
        m = re.search(r"\[(\d+)\]", path)
        if m:
            self.indices.setdefault(path[: m.start()], set()).add(int(m[1]))
        self.seen.add(path)
        self.doc.assignments.append(Assignment(path, kind, text, number, mods, directives))


def parse(text: str) -> list[Document]:
    """The documents of a chain; raises ``NotationError``."""
    if len(text.encode("utf-8", "surrogatepass")) > MOST_BYTES:
        raise NotationError("P011", 0)
    out, s = [], _State()
    lines = text.replace("\r\n", "\n").split("\n")
    i = 0
    while i < len(lines):
        at, line = i + 1, lines[i].strip()
        while '"""' in line and line.count('"""') % 2 and i + 1 < len(lines):
            i += 1
            line += "\n" + lines[i]
        i += 1
        if not line or line.startswith(";"):
            if not line and s.meta and not s.context:
                s.meta = False
            continue
        if line == "---":
            _close(s)
            out.append(s.doc)
            s.begin()
            continue
        if re.match(r"@(import|schema|if)\b", line):
            s.doc.directives.append(line)
            continue
        if line.startswith("{"):
            _header(s, line, at)
            continue
        if s.table is not None and not re.match(r"[A-Za-z_$&][^\s\"=,]*\s*=", line):
            _row(s, line, at)
            continue
        path, found, rest = line.partition("=")
        if not found or not path.strip():
            raise NotationError("P001", at, line[:20])
        s.table = None
        *value, behind = read_value(rest.strip(), at)
        s.add(s.full(path.strip()), value, read_directives(behind, at), at)
    _close(s)
    out.append(s.doc)
    return out


def _header(s: _State, line: str, at: int) -> None:
    m = re.fullmatch(r"\{([^{}]*)\}\s*(?:;.*)?", line)
    if not m:
        raise NotationError("P008", at, line[:20])
    path, s.table = m[1].strip(), None
    s.meta = path.startswith("$")
    if s.meta:
        s.context = path[1:].removeprefix(".")
        return
    columns = re.fullmatch(r"(.+)\[\]\s*:\s*(.+)", path)
    if columns:
        path = columns[1]
    where = path
    if path.startswith("."):
        where = f"{s.absolute}{path}" if s.absolute else path[1:]
    elif path or not columns:
        s.absolute = path
    s.context = where
    if columns:
        names, last = [], ""
        for c in (c.strip() for c in columns[2].split(",")):
            full = f"{last}{c}" if c.startswith(".") else c
            if not c.startswith("."):
                last = c.rpartition(".")[0]
            names.append(full)
        s.table = [where, None if names == ["~"] else names, 0]


def _row(s: _State, line: str, at: int) -> None:
    where, names, k = s.table
    s.table[2] += 1
    rest, column = line, 0
    while rest and not rest.startswith(";"):
        if rest.startswith(","):
            column += 1
            rest = rest[1:].lstrip()
            continue
        head = re.match(r'"(?:[^"\\]|\\.)*"|[^,;]*', rest)[0].rstrip()
        *value, behind = read_value(head or rest, at)
        if behind.strip():
            raise NotationError("P001", at, behind[:20])
        if names is not None and column >= len(names):
            raise NotationError("P001", at, "too many cells")
        s.add(f"{where}[{k}]" if names is None else f"{where}[{k}].{names[column]}", value, (), at)
        rest = rest[len(head) :].lstrip()


def _close(s: _State) -> None:
    for path, found in s.indices.items():
        if found != set(range(len(found))):
            raise NotationError("P013", 0, path)


# Text forms


def quoted(s: str) -> str:
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'


def canonical_number(x: float) -> str:
    shown = repr(float(x))
    return re.sub(r"\.?0+$", "", shown) if "." in shown and "e" not in shown else shown


def canonical_value(kind: str, text: str | None, number: float | None) -> str:
    if kind == "null":
        return "~"
    if kind == "string":
        return quoted(text or "")
    if kind == "number":
        return "#" + canonical_number(number if number is not None else float(text or 0))
    if kind == "currency":
        amount, _, code = (text or "").partition(":")
        places = max(2, len(amount.partition(".")[2]))
        return f"#${float(amount):.{places}f}" + (f":{code.upper()}" if code else "")
    lead = {"integer": "##", "percent": "#%", "reference": "@", "binary": "^", "verb": "%"}.get(kind, "")
    return lead + (text or "")


def sort_key(path: str) -> tuple:
    """Metadata first, extensions last; indices are numbers and stand before names."""
    order = {"$": 0, "&": 2}.get(path[:1], 1)
    return (order, *[(0, int(m[2]), "") if m[2] is not None else (1, 0, m[1]) for m in re.finditer(r"([^.\[\]]+)|\[(\d+)\]", path)])


def canonical(assignments) -> str:
    """The canonical text of (path, type, text, number, mods) rows."""
    lines = sorted(((sort_key(a.path), a) for a in assignments), key=lambda x: x[0])
    return "".join(f"{a.path} = {''.join(_SIGN[m] for m in MODIFIERS.values() if m in (a.mods or ()))}{canonical_value(a.type, a.text, a.number)}\n" for _, a in lines)


def stringify(assignments, *, headers: bool = True, sort_paths: bool = False) -> str:
    """Text with a header for each object; metadata under ``{$}``."""
    rows = sorted(assignments, key=lambda a: sort_key(a.path)) if sort_paths else list(assignments)
    meta = [a for a in rows if a.path.startswith("$.")]
    rest = [a for a in rows if not a.path.startswith("$.")]
    show = lambda a, name: f"{name} = {''.join(_SIGN[m] for m in MODIFIERS.values() if m in (a.mods or ()))}{canonical_value(a.type, a.text, a.number)}"
    out = ["{$}", *[show(a, a.path[2:]) for a in meta], ""] if meta else []
    if not headers:
        return "\n".join(out + [show(a, a.path) for a in rest]) + "\n"
    groups: dict[str, list] = {}
    for a in rest:
        groups.setdefault(a.path.rpartition(".")[0], []).append(a)
    for head in sorted(groups, key=lambda h: h != ""):
        out += ([f"{{{head}}}"] if head else []) + [show(a, a.path.rpartition(".")[2]) for a in groups[head]]
    return "\n".join(out) + "\n"
