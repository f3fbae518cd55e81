"""Logic, comparison, type tests, coercion, generation and lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import (
    FLOATS, INTEGERS, NUMBERS, CompileError, Value, array_value, bool_value, cast_to, common_type, const, double_value, integral, is_object, long_value, need_literal, number, number0, same, text0,
    text_value, truthy, verb,
)
from .strings import BLANKS

verb("eq", 2)(lambda ctx, a, b: bool_value(same(a, b)))
verb("ne", 2)(lambda ctx, a, b: bool_value(~same(a, b)))
verb("lt", 2)(lambda ctx, a, b: bool_value(number0(a) < number0(b)))
verb("lte", 2)(lambda ctx, a, b: bool_value(number0(a) <= number0(b)))
verb("gt", 2)(lambda ctx, a, b: bool_value(number0(a) > number0(b)))
verb("gte", 2)(lambda ctx, a, b: bool_value(number0(a) >= number0(b)))
verb("and", 2)(lambda ctx, a, b: bool_value(truthy(a) & truthy(b)))
verb("or", 2)(lambda ctx, a, b: bool_value(truthy(a) | truthy(b)))
verb("xor", 2)(lambda ctx, a, b: bool_value(truthy(a) != truthy(b)))
verb("not", 1)(lambda ctx, v: bool_value(~truthy(v)))
verb("isNull", 1, "B")(lambda ctx, v: bool_value(v.col.isNull()))


def branches(pairs, default: Value | None) -> Value:
    values = [v for _, v in pairs] + ([default] if default is not None else [])
    t = common_type(values)
    out = None
    for test, v in pairs:
        out = F.when(test, cast_to(v, t)) if out is None else out.when(test, cast_to(v, t))
    if out is None:
        return default if default is not None else const(None)
    return Value(out.otherwise(cast_to(default, t)) if default is not None else out, t)


@verb("ifElse", 3)
def if_else(ctx, c, a, b=None):
    return branches([(truthy(c), a)], b)


@verb("cond", None)
def cond(ctx, *args):
    pairs = [(truthy(args[i]), args[i + 1]) for i in range(0, len(args) - 1, 2)]
    return branches(pairs, args[-1] if len(args) % 2 else None)


@verb("switch", None)
def switch(ctx, v, *args):
    pairs = [(same(v, args[i]), args[i + 1]) for i in range(0, len(args) - 1, 2)]
    return branches(pairs, args[-1] if len(args) % 2 else None)


@verb("coalesce", None, "B")
def coalesce(ctx, *args):
    t = common_type(list(args))
    return Value(F.coalesce(*[cast_to(a, t) for a in args]), t)


verb("ifNull", 2, "B")(coalesce)


@verb("ifEmpty", 2)
def if_empty(ctx, a, b):
    t = common_type([a, b])
    return Value(F.when(text0(a) == "", cast_to(b, t)).otherwise(cast_to(a, t)), t)


def type_test(*kinds):
    return lambda ctx, v: bool_value(v.col.isNotNull() & F.lit(isinstance(v.type, kinds)))


verb("isString", 1)(type_test(T.StringType))
verb("isNumber", 1)(type_test(*NUMBERS))
verb("isBoolean", 1)(type_test(T.BooleanType))
verb("isArray", 1)(type_test(T.ArrayType))
verb("isObject", 1)(type_test(T.StructType, T.MapType))
verb("isDate", 1)(type_test(T.DateType))

#: Names of types as ``typeOf`` gives them (fixed values).
TYPE_NAMES = ((T.BooleanType, "bool"), (INTEGERS, "integer"), (T.DecimalType, "currency"), (FLOATS, "float"), (T.StringType, "string"), (T.DateType, "date"), (T.TimestampType, "timestamp"), (T.ArrayType, "array"), ((T.StructType, T.MapType), "object"))


@verb("typeOf", 1)
def type_of(ctx, v):
    name = next((n for kind, n in TYPE_NAMES if isinstance(v.type, kind)), "null")
    return text_value(F.when(v.col.isNull(), F.lit("null")).otherwise(F.lit(name)))


@verb("assert", 2)
def assert_(ctx, c, message=None):
    """True, or a row error: the failing field stays empty and the message is recorded."""
    said = text0(message) if message is not None else F.lit("assertion failed")
    ctx.errors.append(F.when(~truthy(c), F.concat(F.lit("E001: "), said)))
    return bool_value(F.when(truthy(c), F.lit(True)))


verb("coerceString", 1)(lambda ctx, v: text_value(text0(v)))
verb("coerceNumber", 1)(lambda ctx, v: double_value(number0(v)))
verb("coerceInteger", 1)(lambda ctx, v: long_value(number0(v)))
verb("coerceBoolean", 1)(lambda ctx, v: bool_value(truthy(v)))


@verb("tryCoerce", 1)
def try_coerce(ctx, v):
    """A text as the most specific thing it spells. Where rows differ in kind the result is a VARIANT."""
    if not isinstance(v.type, T.StringType):
        return v
    s = F.btrim(v.col, F.lit(BLANKS))
    json = F.when(s.isin("true", "false"), s).when(F.regexp_like(s, F.lit(r"^-?(0|[1-9]\d{0,17})$")), s).when(F.regexp_like(s, F.lit(r"^-?(0|[1-9]\d*)\.\d+$")), s)
    quoted = F.to_json(F.array(v.col))
    return Value(F.when(v.col.isNotNull(), F.try_parse_json(F.coalesce(json, F.substring(quoted, F.lit(2), F.length(quoted) - 2)))), T.VariantType())


@verb("toArray", 1)
def to_array(ctx, v):
    if isinstance(v.type, T.ArrayType):
        return v
    if v.is_null:
        return array_value(F.array().cast("array<string>"), T.StringType())
    return array_value(F.when(v.col.isNull(), F.array().cast(T.ArrayType(v.type))).otherwise(F.array(v.col)), v.type)


@verb("toObject", 1)
def to_object(ctx, v):
    if is_object(v):
        return v
    if isinstance(v.type, T.ArrayType):
        pairs = F.transform(v.col, lambda x, i: F.struct(i.cast("string").alias("key"), x.alias("value")))
        return Value(F.map_from_entries(pairs), T.MapType(T.StringType(), v.type.elementType))
    if v.is_null:
        return Value(F.create_map().cast("map<string,string>"), T.MapType(T.StringType(), T.StringType()))
    return Value(F.struct(v.col.alias("value")), T.StructType([T.StructField("value", v.type)]))


ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"


@verb("nanoid", 2)
def nanoid(ctx, n=None, *_):
    size = F.greatest(F.lit(1), number0(n).cast("int")) if n is not None and not n.is_null else F.lit(21)
    return text_value(F.array_join(F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(F.lit(ALPHABET), F.pmod(F.xxhash64(F.uuid(), i), F.lit(64)).cast("int") + 1, F.lit(1))), ""))


def _hash_bytes(c, start: int):
    """The 32-bit multiply-and-xor hash over a text's bytes, as a whole-stage expression."""
    codes = F.transform(F.sequence(F.lit(1), F.length(F.encode(c, "UTF-8"))), lambda i: F.conv(F.hex(F.substring(F.encode(c, "UTF-8"), i, F.lit(1))), 16, 10).cast("long"))
    codes = F.when(c == "", F.array().cast("array<bigint>")).otherwise(codes)
    return F.aggregate(codes, F.lit(start).cast("long"), lambda h, x: ((h * 33).bitwiseXOR(x)).bitwiseAND(F.lit(0xFFFFFFFF)))


@verb("uuid", 1)
def uuid(ctx, *args):
    """Random, or from a text seed: two hashes give the bytes, marked version 5."""
    if not args or args[-1].is_null or not isinstance(args[-1].type, T.StringType):
        return text_value(F.concat(text0(args[0]), F.uuid()) if args else F.uuid())
    seed, prefix = text0(args[-1]), text0(args[0]) if len(args) > 1 else F.lit("")

    def eight(start):
        h = _hash_bytes(seed, start)
        signed = F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)
        return [F.shiftright(signed, 4 * i).bitwiseAND(F.lit(0xFF)) for i in range(8)]

    b = eight(5381) + eight(52711)
    b[6] = b[6].bitwiseAND(F.lit(0x0F)).bitwiseOR(F.lit(0x50))
    b[8] = b[8].bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))
    h = [F.lower(F.lpad(F.hex(x), 2, "0")) for x in b]
    dash = F.lit("-")
    return text_value(F.concat(prefix, *h[:4], dash, *h[4:6], dash, *h[6:8], dash, *h[8:10], dash, *h[10:]))


def _lookup(ctx, args, default):
    path = str(need_literal(args[0], "a table's name"))
    name, _, column = path.partition(".")
    table = ctx.tables.get(name)
    if table is None:
        return default if default is not None else const(None)
    columns, rows = table
    if column not in columns:
        return default if default is not None else const(None)
    keys = [c for c in columns if c != column][: len(args) - 1]
    values = [const(r.get(column)) for r in rows]
    t = common_type(values + ([default] if default is not None else []))
    seen, pairs = set(), []
    for r, v in zip(rows, values, strict=True):
        # Of rows with equal keys the first counts: later ones never match.
        own = tuple(_spelt(r.get(k)) for k in keys)
        if own not in seen:
            seen.add(own)
            pairs.append((own, v))
    separator = "\x1f"
    entries = F.map_from_arrays(F.array(*[F.lit(separator.join(k)) for k, _ in pairs]), F.array(*[F.struct(cast_to(v, t).alias("v")) for _, v in pairs])) if pairs else None
    if entries is None:
        return default if default is not None else const(None)
    key = F.concat_ws(separator, *[text0(a) for a in args[1 : 1 + len(keys)]])
    hit = F.try_element_at(entries, key)
    if default is None:
        return Value(hit.getField("v"), t)
    return Value(F.when(hit.isNull(), cast_to(default, t)).otherwise(hit.getField("v")), t)


def _spelt(x) -> str:
    return "" if x is None else str(x).lower() if isinstance(x, bool) else str(x)


@verb("lookup", None)
def lookup(ctx, *args):
    """The first row of an inline table whose other columns equal the keys, by a map literal: no join."""
    return _lookup(ctx, args, None)


@verb("lookupDefault", None)
def lookup_default(ctx, *args):
    return _lookup(ctx, args[:-1], args[-1])


def _ordered(ctx, name):
    if ctx.streaming:
        raise CompileError(f"{name} needs an order of all rows: not on a stream")
    if not ctx.order:
        raise CompileError(f"{name} needs the order of rows: give order=")
    if not ctx.partition:
        raise CompileError(f"{name} over all rows would be one task: give partition=, or use series.running_over_all")
    return Window.partitionBy(*ctx.partition).orderBy(*ctx.order)


verb("rowNumber", 1, "W")(lambda ctx, *_: long_value(F.row_number().over(_ordered(ctx, "rowNumber"))))
verb("sequence", 1, "W")(lambda ctx, *_: long_value(F.row_number().over(_ordered(ctx, "sequence")) - 1))
verb("resetSequence", 1, "W")(lambda ctx, *_: const(0))


@verb("accumulate", 2, "W")
def accumulate(ctx, name, v):
    """The accumulator after this row: its start and all values up to here."""
    key = str(need_literal(name, "an accumulator's name"))
    start = ctx.accumulators.get(key, 0)
    w = _ordered(ctx, "accumulate").rowsBetween(Window.unboundedPreceding, 0)
    ctx.used.add(key)
    whole = integral(v) and isinstance(start, int)
    total = F.lit(float(start or 0)) + F.coalesce(F.sum(number(v)).over(w), F.lit(0.0))
    return long_value(total) if whole else double_value(total)


@verb("set", 2, "W")
def set_(ctx, name, v):
    ctx.used.add(str(need_literal(name, "an accumulator's name")))
    return v
