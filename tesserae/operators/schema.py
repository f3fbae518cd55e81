"""The schema language: text to validation rules and back, with imports. Runs on the driver."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from .validation import ArrayRule, FieldRule, Schema

#: Prefixes and keywords of types, longest first (fixed values).
PREFIXES = (("##", "integer"), ("#$", "currency"), ("#%", "percent"), ("#", "number"), ("?", "boolean"), ("@", "reference"), ("^", "binary"), ("~", "null"))
KEYWORDS = ("timestamp", "date", "time", "duration", "string", "integer", "number", "boolean", "currency", "percent", "binary", "reference", "null")
MOST_IMPORTS, MOST_NESTING = 1000, 32


@dataclass
class SchemaText:
    """A parsed schema: types with their fields, where they are used, and rules as ``validation.Schema``."""

    metadata: dict = field(default_factory=dict)
    types: dict = field(default_factory=dict)
    uses: dict = field(default_factory=dict)
    imports: list = field(default_factory=list)
    rules: Schema = field(default_factory=Schema)

    def resolved(self) -> Schema:
        """Rules with the fields of types added under every path that uses them."""
        out = Schema(list(self.rules.fields), list(self.rules.arrays), list(self.rules.invariants), list(self.rules.cardinalities), self.rules.strict)
        pending, seen = list(self.uses.items()), set()
        while pending:
            path, name = pending.pop()
            if (path, name) in seen or path.count(".") > MOST_NESTING:
                continue
            seen.add((path, name))
            fields, uses = self.types.get(name, ([], {}))
            out.fields += [FieldRule(**{**f.__dict__, "path": f"{path}.{f.path}"}) for f in fields]
            pending += [(f"{path}.{p}", n) for p, n in uses.items()]
        return out

    @property
    def circular(self) -> list[str]:
        """Types that contain themselves (V012)."""
        reach = {n: set(u.values()) for n, (_, u) in self.types.items()}
        for _ in reach:
            reach = {n: set().union(r, *[reach.get(m, set()) for m in r]) for n, r in reach.items()}
        return sorted(n for n, r in reach.items() if n in r)

    @property
    def unresolved(self) -> list[str]:
        """Type references to no type (V013)."""
        used = set(self.uses.values()).union(*[u.values() for _, u in self.types.values()])
        return sorted(n for n in used if n not in self.types and not any(t.endswith(f".{n}") or t.endswith(f"_{n}") for t in self.types))


def scalar(s: str):
    s = s.strip().strip("\"'")
    if re.fullmatch(r"-?\d+", s):
        return int(s)
    if re.fullmatch(r"-?\d+\.\d+", s):
        return float(s)
    return {"true": True, "false": False}.get(s, s)


#: Parts of a field's specification after its type: name and pattern.
_PARTS = re.compile(
    r":\((?P<bounds>[^)]*)\)|:/(?P<pattern>(?:[^/\\]|\\.)*)/|:pattern\s+\"(?P<quoted>[^\"]*)\"|:format\s+(?P<format>[^\s:]+)|:(?P<unless>if|unless)\s+(?P<name>\w[\w.]*)(?:\s*(?P<op>>=|<=|!=|>|<|=)\s*(?P<value>\S+))?|:(?P<flag>unique|computed|immutable)"
)


def field_rule(path: str, spec: str) -> tuple[FieldRule, str | None, bool]:
    """(rule, name of a type it refers to, whether its values are unique)."""
    m = re.match(r"[!~*-]*", spec)
    rule = FieldRule(path, required="!" in m[0])
    rest = spec[m.end() :].strip()
    used, unique = None, False
    listed = re.match(r"\(([^)]*)\)", rest)
    if listed:
        rule.type, rule.enum, rest = "string", tuple(v.strip().strip("\"'") for v in listed[1].split(",")), rest[listed.end() :]
    else:
        prefix = next(((p, t) for p, t in PREFIXES if rest.startswith(p)), None)
        word = re.match(rf"({'|'.join(KEYWORDS)})(?=[\s:,)]|$)", rest)
        if prefix:
            rule.type, rest = prefix[1], re.sub(r"^\.\d", "", rest[len(prefix[0]) :].lstrip())
            name = re.match(r"[^\s:,)]+", rest) if prefix[0] == "@" else None
            if name:
                used, rule.type, rest = name[0], None, rest[name.end() :]
        elif word:
            rule.type, rest = word[1], rest[word.end() :]
        else:
            rule.type = "string"
    for p in _PARTS.finditer(rest):
        if p["bounds"] is not None:
            low, dots, high = p["bounds"].partition("..")
            rule.minimum = scalar(low) if low.strip() else None
            rule.maximum = (scalar(high) if high.strip() else None) if dots else rule.minimum
        elif p["pattern"] is not None or p["quoted"] is not None:
            rule.pattern = p["pattern"] if p["pattern"] is not None else p["quoted"]
        elif p["format"]:
            rule.format = p["format"]
        elif p["name"]:
            rule.condition = (p["name"], p["op"] or "=", scalar(p["value"]) if p["value"] else True, p["unless"] == "unless")
        elif p["flag"] == "computed":
            rule.computed = True
        elif p["flag"] == "unique":
            unique = True
    return rule, used, unique


def parse(text: str) -> SchemaText:
    out = SchemaText()
    kind, scope = "root", ""
    for raw in text.split("\n"):
        line = re.match(r'(?:[^;"]|"[^"]*")*', raw.strip())[0].rstrip()
        if not raw.strip():
            kind, scope = ("root", "") if kind == "metadata" else (kind, scope)
            continue
        if not line:
            continue
        head = re.match(r"\{([^}]*)\}\s*(.*)$", line)
        if line.startswith("@import "):
            m = re.match(r'@import\s+"?([^"\s]+)"?(?:\s+as\s+(\w+))?', line)
            out.imports.append((m[1], m[2]))
        elif head:
            name = head[1].strip()
            if name.startswith("$"):
                kind, scope = "metadata", name
            elif name.startswith("@"):
                kind, scope = "type", name[1:]
                out.types.setdefault(scope, ([], {}))
            elif name.endswith("[]"):
                kind, scope = "array", name[:-2]
                out.rules.arrays.append(_array(ArrayRule(scope), head[2]))
            else:
                kind, scope = "object", name
        elif line.startswith("@") and "=" not in line:
            kind, scope = "type", line[1:].strip()
            out.types.setdefault(scope, ([], {}))
        elif line.startswith(":"):
            _constraint(out, kind, scope, line)
        elif "=" in line:
            _field(out, kind, scope, *[s.strip() for s in line.split("=", 1)])
    return out


def _array(rule: ArrayRule, text: str) -> ArrayRule:
    bounds = re.search(r":\((\d*)\.\.(\d*)\)", text)
    if bounds:
        rule.minimum = int(bounds[1]) if bounds[1] else rule.minimum
        rule.maximum = int(bounds[2]) if bounds[2] else rule.maximum
    rule.unique |= ":unique" in text
    return rule


def _constraint(out: SchemaText, kind: str, scope: str, line: str) -> None:
    if kind == "array" and re.match(r":\(|:unique", line):
        _array(out.rules.arrays[-1], line)
        return
    invariant = re.match(r":invariant\s+([\w.]+)\s*(>=|<=|!=|==|>|<|=)\s*(.+)$", line)
    if invariant:
        out.rules.invariants.append((scope, invariant[1], invariant[2], scalar(invariant[3])))
        return
    m = re.match(r":(of|one_of|exactly_one|at_most_one)\s+(?:\((\d*)\.\.(\d*)\)\s*)?(.+)$", line)
    if m:
        least, most = {"of": (m[2], m[3]), "one_of": (1, None), "exactly_one": (1, 1), "at_most_one": (None, 1)}[m[1]]
        names = tuple(n.strip() for n in m[4].split(",") if n.strip())
        out.rules.cardinalities.append((scope, names, int(least) if least not in (None, "") else None, int(most) if most not in (None, "") else None))


def _field(out: SchemaText, kind: str, scope: str, name: str, spec: str) -> None:
    spec = spec[1:-1] if len(spec) > 1 and spec[0] == spec[-1] == '"' else spec
    if kind == "metadata":
        out.metadata[name] = spec
        return
    if not name:
        if kind == "array":
            _array(out.rules.arrays[-1], spec)
        return
    name = name.removesuffix("[]")
    path = {"type": name, "array": f"{scope}[].{name}"}.get(kind, f"{scope}.{name}" if scope else name)
    rule, used, unique = field_rule(path, spec)
    if kind == "array" and unique:
        out.rules.arrays[-1].unique_field = name
    fields, uses = out.types[scope] if kind == "type" else (out.rules.fields, out.uses)
    if used:
        uses[path] = used
        if not rule.required:
            return
    fields.append(rule)


def load(path: str, *, root: str | None = None) -> SchemaText:
    """A schema file with its imports: imported first, the importing file overrides; cycles are an error."""
    root = os.path.realpath(root or os.path.dirname(path))
    count = 0

    def one(p: str, trail: tuple) -> SchemaText:
        nonlocal count
        p = os.path.realpath(p)
        count += 1
        if p in trail:
            raise ValueError(f"circular import of {p}")
        if len(trail) > MOST_NESTING or count > MOST_IMPORTS:
            raise ValueError("too many imports")
        if os.path.commonpath([root, p]) != root:
            raise ValueError(f"import outside {root}")
        with open(p, encoding="utf-8") as f:
            own = parse(f.read())
        whole = SchemaText()
        for target, alias in own.imports:
            merge(whole, one(os.path.join(os.path.dirname(p), target), (*trail, p)), alias)
        merge(whole, own, None)
        return whole

    return one(path, ())


def merge(into: SchemaText, other: SchemaText, alias: str | None) -> None:
    """Add another schema; its types get the alias as a prefix, its fields replace those of equal paths."""
    lead = f"{alias}." if alias else ""
    into.types |= {lead + n: t for n, t in other.types.items()}
    into.uses |= other.uses
    into.metadata |= other.metadata
    paths = {f.path for f in other.rules.fields}
    into.rules.fields = [f for f in into.rules.fields if f.path not in paths] + other.rules.fields
    arrays = {a.path for a in other.rules.arrays}
    into.rules.arrays = [a for a in into.rules.arrays if a.path not in arrays] + other.rules.arrays
    into.rules.invariants += other.rules.invariants
    into.rules.cardinalities += other.rules.cardinalities


def specification(f: FieldRule) -> str:
    """A field's rule as text."""
    out = "!" if f.required else ""
    prefix = {t: p for p, t in reversed(PREFIXES)}
    out += f"({', '.join(f.enum)})" if f.enum else prefix.get(f.type or "", "" if f.type in (None, "string") else f.type)
    if f.minimum is not None or f.maximum is not None:
        out += " :({}..{})".format("" if f.minimum is None else f.minimum, "" if f.maximum is None else f.maximum)
    out += f" :/{f.pattern}/" if f.pattern else ""
    out += f" :format {f.format}" if f.format else ""
    if f.condition:
        name, op, value, negated = f.condition
        shown = str(value).lower() if isinstance(value, bool) else value
        out += f" :{'unless' if negated else 'if'} {name} {op} {shown}"
    return (out + (" :computed" if f.computed else "")).strip()


def serialise(s: SchemaText) -> str:
    """Schema text that parses to the same rules."""
    lines = ["{$}", *[f'{k} = "{v}"' for k, v in s.metadata.items()], ""] if s.metadata else []
    lines += [f'@import "{p}"' + (f" as {a}" if a else "") for p, a in s.imports]
    for name, (fields, uses) in s.types.items():
        lines += [f"{{@{name}}}", *[f"{f.path} = {specification(f)}" for f in fields if f.path not in uses], *[f"{p} = @{n}" for p, n in uses.items()]]
    scopes: dict[str, list[str]] = {}
    for f in s.rules.fields:
        if "[]." not in f.path and f.path not in s.uses:
            head, _, leaf = f.path.rpartition(".")
            scopes.setdefault(head, []).append(f"{leaf} = {specification(f)}")
    for p, n in s.uses.items():
        head, _, leaf = p.rpartition(".")
        scopes.setdefault(head, []).append(f"{leaf} = {'!' if any(f.path == p for f in s.rules.fields) else ''}@{n}")
    for scope, left, op, right in s.rules.invariants:
        scopes.setdefault(scope, []).append(f":invariant {left} {op} {str(right).lower() if isinstance(right, bool) else right}")
    for scope, names, least, most in s.rules.cardinalities:
        scopes.setdefault(scope, []).append(f":of ({'' if least is None else least}..{'' if most is None else most}) {', '.join(names)}")
    for scope in sorted(scopes):
        lines += [f"{{{scope}}}", *scopes[scope]]
    for a in s.rules.arrays:
        bounds = f" :({'' if a.minimum is None else a.minimum}..{'' if a.maximum is None else a.maximum})" if a.minimum is not None or a.maximum is not None else ""
        lines.append(f"{{{a.path}[]}}" + bounds + (" :unique" if a.unique else ""))
        lead = f"{a.path}[]."
        lines += [f"{f.path.removeprefix(lead)} = {specification(f)}" + (" :unique" if f.path == lead + (a.unique_field or "\0") else "") for f in s.rules.fields if f.path.startswith(lead)]
    return "\n".join(lines) + "\n"
