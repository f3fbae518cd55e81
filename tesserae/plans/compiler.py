"""From a plan and a schema to columns: one projection, which Catalyst folds, prunes and pushes down.

A row is a source object. Loops over a row's arrays become ``transform``; verbs over the order of rows become windows,
whose order and partition the caller names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import collections, dates, logic, numerics, strings  # noqa: F401  (they register the verbs)
from ..functions.kernel import VERBS, CompileError, Context, Value, array_value, cast_to, common_type, const, element, integral, item, long_value, member, number, number0, same, text, text0, text_value, truthy
from .mapping import Build, Call, Copy, Literal, Mapping, Plan, Segment, parse, parse_expression

#: Verbs of the text language that users add: name to builder.
CUSTOM: dict = {}


def register_verb(name: str, build) -> None:
    """Make ``%&name`` call ``build(context, *values) -> Value``; without it, it gives its first operand."""
    CUSTOM[name] = build


#: Operators of conditions, in the order in which they are looked for (fixed values).
OPERATORS = ("!=", "<>", "<=", ">=", "==", "=", "<", ">")
_STEP = re.compile(r"([^.\[\]]+)|\[(-?\d+)\]")


@dataclass
class Scope:
    """Where paths start: the row, or an item of a loop with its place."""

    fields: dict
    item: Value | None = None
    index: Column | None = None
    loop: Value | None = None
    counter: str | None = None
    totals: dict = field(default_factory=dict)


class Compiler:
    def __init__(self, plan: Plan, df: DataFrame, order=(), partition=(), streaming=False):
        self.plan, self.df = plan, df
        self.context = Context(tuple(order), tuple(partition), plan.tables, {k: a.initial for k, a in plan.accumulators.items()}, streaming)
        self.root = Scope({f.name: Value(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields})
        self.finals: dict[str, Value] = {}

    # Expressions

    def value(self, expr, scope: Scope) -> Value:
        if isinstance(expr, Literal):
            return const(expr.value)
        if isinstance(expr, Copy):
            return self.extract(self.path(expr.path, scope), expr.directives)
        if isinstance(expr, Build):
            parts = [(n, self.value(e, scope)) for n, e in expr.fields]
            return Value(F.struct(*[v.col.alias(n) for n, v in parts]), T.StructType([T.StructField(n, v.type) for n, v in parts]))
        return self.call(expr, scope)

    def call(self, expr: Call, scope: Scope) -> Value:
        if expr.custom:
            build = CUSTOM.get(expr.verb)
            args = [self.value(a, scope) for a in expr.args]
            return build(self.context, *args) if build else (args[0] if args else const(None))
        verb = VERBS.get(expr.verb)
        if verb is None:
            raise CompileError(f"T001: unknown verb {expr.verb}")
        if scope.item is not None and verb.kind == "W" and expr.verb in ("rowNumber", "sequence", "resetSequence", "accumulate", "set"):
            return self.in_loop(expr, scope)
        out = verb.build(self.context, *[self.value(a, scope) for a in expr.args])
        if expr.verb == "accumulate":
            self.final_of_rows(expr, scope, out)
        return out

    def in_loop(self, expr: Call, scope: Scope) -> Value:
        """Verbs of row order, over the items of a loop."""
        if expr.verb == "rowNumber":
            return long_value(scope.index + 1)
        if expr.verb == "sequence":
            return long_value(scope.index)
        if expr.verb == "resetSequence":
            return const(0)
        name = str(expr.args[0].value)
        v = self.value(expr.args[1], scope)
        if expr.verb == "set":
            last = F.get(scope.loop.col, F.size(scope.loop.col) - 1)
            self.finals[name] = self.value(expr.args[1], replace(scope, item=item(last, scope.loop), index=F.size(scope.loop.col) - 1))
            return v
        start = self.context.accumulators.get(name) or 0
        whole = integral(v) and isinstance(start, int)

        def total(arr):
            step = lambda s, x: s + F.coalesce(number(self.value(expr.args[1], replace(scope, item=item(x, scope.loop)))), F.lit(0.0))
            c = F.aggregate(arr, F.lit(float(start)), step)
            return long_value(c) if whole else Value(c, T.DoubleType())

        self.finals[name] = total(F.coalesce(scope.loop.col, F.array().cast(scope.loop.type)))
        return total(F.slice(scope.loop.col, F.lit(1), scope.index + 1))

    def final_of_rows(self, expr: Call, scope: Scope, running: Value) -> None:
        name = str(expr.args[0].value)
        v = self.value(expr.args[1], scope)
        start = float(self.context.accumulators.get(name) or 0)
        c = F.lit(start) + F.coalesce(F.sum(number(v)).over(Window.partitionBy(*self.context.partition)), F.lit(0.0))
        self.finals[name] = Value(c.cast(running.type), running.type)

    def path(self, path: str, scope: Scope) -> Value:
        path = path.removeprefix(".")
        if path.startswith("$"):
            kind, _, name = path[1:].partition(".")
            if kind in ("const", "constants"):
                return const(self.plan.constants.get(name))
            if kind in ("accumulator", "accumulators"):
                return self.finals.get(name) or const(self.context.accumulators.get(name))
            return const(None)
        if scope.item is not None:
            if path in ("_index", scope.counter):
                return long_value(scope.index)
            if path == "_length":
                return long_value(F.size(scope.loop.col))
        steps = [(m[1], m[2]) for m in _STEP.finditer(path)]
        if scope.item is not None:
            v = scope.item
            if steps and steps[0][0] == "_item":
                steps = steps[1:]
        elif not steps:
            return Value(F.struct(*[v.col.alias(n) for n, v in scope.fields.items()]), self.df.schema)
        else:
            v = scope.fields.get(steps[0][0] or "")
            if v is None:
                return const(None)
            steps = steps[1:]
        for name, index in steps:
            if v.is_null:
                return v
            if name is not None:
                v = member(v, name)
            elif isinstance(v.type, T.ArrayType):
                v = Value(F.get(v.col, F.lit(int(index))), element(v))
            elif isinstance(v.type, T.StringType):
                v = text_value(F.get_json_object(v.col, f"$[{index}]"))
            else:
                return const(None)
        return v

    def extract(self, v: Value, directives) -> Value:
        """Parts of a source's text; for other sources the same directives place fields in the target."""
        d = dict(directives) if self.plan.source_format in EXTRACTED else {}
        if "pos" in d:
            length = F.lit(int(d["len"])) if "len" in d else F.lit(1 << 30)
            v = text_value(F.substring(text0(v), F.lit(int(d["pos"]) + 1), length))
        elif "field" in d:
            delimiter = re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", self.plan.source.get("delimiter") or ",")
            v = text_value(F.get(F.split(text0(v), delimiter, -1), F.lit(int(d["field"]))))
        return text_value(F.btrim(text(v), F.lit(strings.BLANKS))) if d.get("trim") and isinstance(v.type, T.StringType) else v

    # Directives behind a mapping

    def directed(self, v: Value, directives) -> Value:
        d = dict(directives)
        kind = d.get("type") or next((k for k in ("date", "time", "timestamp", "integer", "number", "boolean", "duration") if k in d), None)
        if kind:
            v = coerced(v, str(kind))
        if "decimals" in d:
            v = Value(F.round(number(v), int(d["decimals"])), T.DoubleType())
        if d.get("trim"):
            v = VERBS["trim"].build(self.context, v)
        for name in ("upper", "lower"):
            if d.get(name):
                v = VERBS[name].build(self.context, v)
        for name in ("maxLen", "truncate"):
            if name in d and d[name] is not True and isinstance(v.type, T.StringType):
                v = text_value(F.left(v.col, F.lit(int(d[name]))))
        if "default" in d:
            other = coerced(const(d["default"] if d["default"] is not True else ""), str(kind)) if kind else const(d["default"])
            t = common_type([v, other])
            v = Value(F.coalesce(cast_to(v, t), cast_to(other, t)), t)
        return v

    # Conditions

    def condition(self, raw: str, scope: Scope) -> Column:
        raw = raw.strip()
        if not raw.startswith("%"):
            for op in OPERATORS:
                left, found, right = raw.partition(op)
                if found:
                    a, b = (self.value(parse_expression(s)[0], scope) for s in (left, right))
                    if op in ("=", "=="):
                        return same(a, b)
                    if op in ("!=", "<>"):
                        return ~same(a, b)
                    x, y = number0(a), number0(b)
                    return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        return truthy(self.value(parse_expression(raw)[0], scope))

    def guard(self, s: Segment, scope: Scope) -> Column | None:
        tests = [self.condition(c, scope) for c in (s.when, s.condition) if c]
        if s.discriminator:
            tests.append(text0(self.path(s.discriminator.removeprefix("@"), scope)) == F.lit(s.discriminator_value or ""))
        out = None
        for t in tests:
            out = t if out is None else out & t
        return out

    # Segments

    def fields(self, s: Segment, scope: Scope) -> dict:
        tree: dict = {}
        for m in s.mappings:
            v = self.mapped(m, scope)
            if m.target != "_":
                put(tree, m.target, v)
        for child in s.children:
            put(tree, child.name, self.segment(child, scope))
        return tree

    def mapped(self, m: Mapping, scope: Scope) -> Value:
        v = self.directed(self.value(m.expr, scope), m.directives)
        mode = (self.plan.header.get("enforceConfidential") or "").lower()
        if "confidential" in m.modifiers and mode in ("redact", "mask"):
            if mode == "mask" and isinstance(v.type, T.StringType):
                return text_value(F.when(v.col.isNotNull(), F.repeat(F.lit("*"), F.greatest(F.length(v.col), F.lit(3)))))
            return Value(F.lit(None).cast(v.type), v.type)
        return v

    def segment(self, s: Segment, scope: Scope) -> Value:
        if s.each is not None:
            return self.loop(s, scope)
        out = assembled(self.fields(s, scope))
        test = self.guard(s, scope)
        if s.array:
            one = F.array(out.col)
            return array_value(one if test is None else F.when(test, one).otherwise(F.array().cast(T.ArrayType(out.type))), out.type)
        return out if test is None else Value(F.when(test, out.col), out.type)

    def loop(self, s: Segment, scope: Scope) -> Value:
        source = self.value(parse_expression(s.each if s.each.startswith(("@", "%")) else f"@{s.each}")[0], scope)
        if not isinstance(source.type, T.ArrayType):
            # A scalar is a loop of one, nothing is a loop of none.
            source = VERBS["toArray"].build(self.context, source)
        alone = [m for m in s.mappings if m.target == "_" and not (isinstance(m.expr, Call) and m.expr.verb in ("accumulate", "set"))]
        scalar = alone and len(alone) == len(s.mappings)
        inner_type = []

        def inner(x, i):
            own = replace(scope, item=item(x, source), index=i.cast("long"), loop=source, counter=s.counter)
            v = self.mapped(alone[-1], own) if scalar else assembled(self.fields(s, own))
            inner_type.append((v.type, self.guard(s, own)))
            return v.col

        def passes(x, i):
            own = replace(scope, item=item(x, source), index=i.cast("long"), loop=source, counter=s.counter)
            return self.guard(s, own)

        items = F.coalesce(source.col, F.array().cast(source.type))
        tested = s.when or s.condition or s.discriminator
        out = F.transform(items, inner)
        if tested:
            flags = F.transform(items, passes)
            out = F.filter(out, lambda _, i: F.get(flags, i))
        return array_value(out, inner_type[-1][0])

    def run(self) -> dict:
        """All segments in order of passes: a tree of output columns."""
        tree: dict = {}
        for number_ in self.plan.passes or [0]:
            for s in self.plan.segments:
                if (s.number or 0) != number_:
                    continue
                if s.name in ("", "$root"):
                    test = self.guard(s, self.root)
                    for name, v in self.fields(s, self.root).items():
                        put(tree, name, v if test is None or isinstance(v, dict) else Value(F.when(test, v.col), v.type))
                else:
                    put(tree, f"{s.name}[{s.index}]" if s.index is not None and s.each is None else s.name, self.segment(s, self.root) if s.index is None else unwrapped(self.segment(s, self.root)))
            # What doesn't persist starts anew with the next pass.
            self.finals = {k: v for k, v in self.finals.items() if (a := self.plan.accumulators.get(k)) and a.persist}
        return tree


def unwrapped(v: Value) -> Value:
    return Value(F.get(v.col, F.lit(0)), v.type.elementType) if isinstance(v.type, T.ArrayType) else v


def put(tree: dict, target: str, v) -> None:
    """Place a value at a dotted, indexed target; objects met on the way are merged, later fields win."""
    steps = [(m[1] if m[1] is not None else int(m[2])) for m in _STEP.finditer(target)]
    for step in steps[:-1]:
        below = tree.get(step)
        if isinstance(below, Value):
            below = split_struct(below)
        tree = tree.setdefault(step, {}) if below is None else (tree.__setitem__(step, below) or below)
    last, old = steps[-1], tree.get(steps[-1])
    if isinstance(old, Value) and isinstance(v, Value) and isinstance(old.type, T.StructType) and isinstance(v.type, T.StructType):
        tree[last] = {**split_struct(old), **split_struct(v)}
    elif isinstance(old, dict) and isinstance(v, Value) and isinstance(v.type, T.StructType):
        old.update(split_struct(v))
    else:
        tree[last] = v


def split_struct(v: Value) -> dict:
    return {f.name: Value(v.col.getField(f.name), f.dataType) for f in v.type.fields} if isinstance(v.type, T.StructType) else {}


def assembled(tree) -> Value:
    """A tree of values as one struct, or an array where the keys are numbers (gaps are null)."""
    if isinstance(tree, Value):
        return tree
    if tree and all(isinstance(k, int) for k in tree):
        parts = [assembled(tree[i]) if i in tree else const(None) for i in range(max(tree) + 1)]
        t = common_type(parts)
        return array_value(F.array(*[cast_to(p, t) for p in parts]), t)
    parts = [(str(k), assembled(v)) for k, v in tree.items()]
    if not parts:
        return Value(F.lit(None).cast("struct<>"), T.StructType([]))
    cols = [(v.col if not v.is_null else F.lit(None).cast("string")).alias(n) for n, v in parts]
    return Value(F.struct(*cols), T.StructType([T.StructField(n, T.StringType() if v.is_null else v.type) for n, v in parts]))


def coerced(v: Value, kind: str) -> Value:
    """What ``:type`` makes of a value."""
    if kind == "string":
        return text_value(text(v))
    if kind == "integer":
        return long_value(number(v))
    if kind in ("number", "percent"):
        return Value(number(v), T.DoubleType())
    if kind == "currency":
        return Value(number(text_value(F.regexp_replace(text(v), r"[$£€,\s]", ""))), T.DoubleType())
    if kind == "boolean":
        s = F.lower(F.btrim(text(v)))
        return Value(F.when(s.isin("true", "yes", "1"), F.lit(True)).when(s.isin("false", "no", "0"), F.lit(False)).otherwise(truthy(v)), T.BooleanType())
    if kind == "date":
        return Value(dates.day(v), T.DateType())
    if kind == "timestamp":
        return dates.stamp(dates.moment(v))
    if kind in ("time", "duration", "reference", "binary"):
        return text_value(text(v))
    return v


#: Source formats whose fields can be cut by ``:pos :len :field :trim``.
EXTRACTED = ("fixed-width", "csv", "delimited", "flat")


class Transform:
    """A parsed mapping, ready to be applied to DataFrames."""

    def __init__(self, source: str | Plan):
        self.plan = parse(source) if isinstance(source, str) else source

    def columns(self, df: DataFrame, *, order=(), partition=(), streaming: bool = False) -> list[Column]:
        c = Compiler(self.plan, df, order, partition, streaming)
        out = []
        for name, node in c.run().items():
            v = assembled(node)
            out.append((v.col if not v.is_null else F.lit(None).cast("string")).alias(str(name)))
        if c.context.errors:
            out.append(F.array_compact(F.array(*c.context.errors)).alias("_errors"))
        return out

    def apply(self, df: DataFrame, *, keep: tuple = (), order=(), partition=()) -> DataFrame:
        """One output row per row of ``df``: the mapping's columns after those of ``keep``.

        ``order`` and ``partition`` serve verbs over the order of rows (rowNumber, sequence, accumulate, set).
        """
        if df.isStreaming:
            from ..streaming.transforms import check

            check(self.plan)
        return df.select(*keep, *self.columns(df, order=order, partition=partition, streaming=df.isStreaming))
