"""The coercion kernel: typed values and the rules by which verbs read them as numbers, texts and truths."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class CompileError(ValueError):
    """A mapping that can't be compiled: unknown verb, wrong operand, unsupported use."""


_NONE = object()


@dataclass(frozen=True)
class Value:
    """A column with its static type; ``literal`` is the constant it stands for, if any."""

    col: Column
    type: T.DataType
    literal: Any = _NONE

    @property
    def is_literal(self) -> bool:
        return self.literal is not _NONE

    @property
    def is_null(self) -> bool:
        return isinstance(self.type, T.NullType)


def const(x: Any) -> Value:
    kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}
    kind = T.NullType() if x is None else kinds[type(x)]
    return Value(F.lit(x).cast(kind) if x is not None else F.lit(None), kind, x)


def text_value(c: Column) -> Value:
    return Value(c, T.StringType())


def double_value(c: Column) -> Value:
    return Value(c, T.DoubleType())


def long_value(c: Column) -> Value:
    return Value(c.cast("long"), T.LongType())


def bool_value(c: Column) -> Value:
    return Value(c, T.BooleanType())


def array_value(c: Column, element: T.DataType) -> Value:
    return Value(c, T.ArrayType(element))


INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType, T.DecimalType)
NUMBERS = INTEGERS + FLOATS
_NUMBER = r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"
_LENIENT = r"^[+-]?(\d+(_\d+)*)(\.\d+(_\d+)*)?([eE][+-]?\d+)?$"


def bound(c: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it. It runs outside generated code: for rare branches."""
    return F.element_at(F.transform(F.array(c), f), 1)


def double_text(c: Column) -> Column:
    """Text of a double: plain digits for exponents -4 to 15, otherwise ``1.0e+16`` style."""
    s = c.cast("string")
    return F.when(F.contains(s, F.lit("E")), bound(s, _moved_point)).otherwise(s)


def _moved_point(s: Column) -> Column:
    """A number's text with an exponent, written out where that is short."""
    mantissa, exponent = F.substring_index(s, "E", 1), F.element_at(F.split(s, "E"), -1).try_cast("int")
    sign = F.when(F.startswith(mantissa, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    whole = F.regexp_replace(mantissa, "^-", "")
    digits = F.replace(whole, F.lit("."), F.lit(""))
    trimmed = F.when(F.endswith(whole, F.lit(".0")), F.substring_index(whole, ".", 1)).otherwise(digits)
    long_digits = F.when(F.length(trimmed) > exponent + 1, trimmed).otherwise(F.rpad(trimmed, exponent + 1, F.lit("0")))
    rest = F.substring(long_digits, exponent + 2, F.length(long_digits))
    big = F.concat(F.left(long_digits, exponent + 1), F.lit("."), F.when(rest == "", F.lit("0")).otherwise(rest))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), trimmed)
    scientific = F.concat(whole, F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    return F.concat(sign, F.when(exponent.between(0, 15), big).when(exponent.between(-4, -1), small).otherwise(scientific))


def text(v: Value) -> Column:
    """Text form, null for null."""
    t = v.type
    if isinstance(t, T.StringType):
        return v.col
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return double_text(v.col.cast("double"))
    if isinstance(t, T.TimestampType):
        return F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if isinstance(t, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(v.col, {"ignoreNullFields": "false"})
    if isinstance(t, T.NullType):
        return F.lit(None).cast("string")
    return v.col.cast("string")


def text0(v: Value) -> Column:
    """Text form, empty for null."""
    return F.coalesce(text(v), F.lit(""))


def number(v: Value) -> Column:
    """The arithmetic reading: null unless numeric, boolean or a text that is a number as a whole."""
    t = v.type
    if isinstance(t, NUMBERS):
        return v.col.cast("double")
    if isinstance(t, T.BooleanType):
        return v.col.cast("int").cast("double")
    if isinstance(t, T.StringType):
        s = F.btrim(v.col, F.lit(" \t\n\r\x0b\x0c"))
        return _text_number(s, _LENIENT)
    return F.lit(None).cast("double")


def _text_number(s: Column, pattern: str) -> Column:
    return F.when(F.regexp_like(s, F.lit(pattern)), F.replace(s, F.lit("_"), F.lit("")).try_cast("double"))


def number0(v: Value) -> Column:
    """The comparing reading: 0 for whatever is no number."""
    if isinstance(v.type, T.StringType):
        return F.coalesce(_text_number(v.col, _NUMBER), F.lit(0.0))
    return F.coalesce(number(v), F.lit(0.0))


def truthy(v: Value) -> Column:
    t = v.type
    if isinstance(t, T.NullType):
        return F.lit(False)
    if isinstance(t, T.BooleanType):
        return F.coalesce(v.col, F.lit(False))
    if isinstance(t, NUMBERS):
        return F.coalesce(v.col != 0, F.lit(False))
    if isinstance(t, T.StringType):
        return F.coalesce(v.col != "", F.lit(False))
    return v.col.isNotNull()


def integral(v: Value) -> bool:
    return isinstance(v.type, INTEGERS) or isinstance(v.type, T.BooleanType)


def numeric_type(*values: Value) -> T.DataType:
    """Whole operands give a whole result; anything else a double."""
    return T.LongType() if all(integral(v) for v in values) else T.DoubleType()


def same(a: Value, b: Value) -> Column:
    """Equality of text forms, null as empty."""
    return text0(a) == text0(b)


def common_type(values: list[Value]) -> T.DataType:
    """The type that branches meet in: theirs if they agree, double for numbers, text otherwise."""
    kinds = [v.type for v in values if not v.is_null]
    if not kinds:
        return T.NullType()
    if all(k == kinds[0] for k in kinds):
        return kinds[0]
    if all(isinstance(k, INTEGERS) for k in kinds):
        return T.LongType()
    if all(isinstance(k, NUMBERS) for k in kinds):
        return T.DoubleType()
    return T.StringType()


def cast_to(v: Value, t: T.DataType) -> Column:
    if v.is_null:
        return F.lit(None).cast(t if not isinstance(t, T.NullType) else "string")
    if v.type == t:
        return v.col
    return text(v) if isinstance(t, T.StringType) else v.col.cast(t)


def array(v: Value) -> Value:
    """An array operand: arrays as they are, texts parsed as JSON arrays of texts."""
    if isinstance(v.type, T.ArrayType):
        return v
    if isinstance(v.type, T.StringType):
        return array_value(F.from_json(v.col, "array<string>"), T.StringType())
    return array_value(F.lit(None).cast("array<string>"), T.StringType())


def element(v: Value) -> T.DataType:
    return v.type.elementType


def item(x: Column, arr: Value) -> Value:
    return Value(x, element(arr))


def numbers(v: Value) -> Column:
    """The numeric items of an array as doubles; others dropped."""
    a = array(v)
    return F.filter(F.transform(a.col, lambda x: number(item(x, a))), lambda x: x.isNotNull())


def member(v: Value, name: str) -> Value:
    """A field of an object, null if there is none."""
    t = v.type
    if isinstance(t, T.StructType):
        if name in t.names:
            return Value(v.col.getField(name), t[name].dataType)
        return const(None)
    if isinstance(t, T.MapType):
        return Value(F.try_element_at(v.col, F.lit(name)), t.valueType)
    if isinstance(t, T.StringType):
        return text_value(F.get_json_object(v.col, f"$.{name}"))
    return const(None)


def is_object(v: Value) -> bool:
    return isinstance(v.type, (T.StructType, T.MapType))


@dataclass
class Verb:
    name: str
    arity: int | None
    build: Callable
    kind: str
    doc: str = ""


@dataclass
class Context:
    """What a verb may need besides its operands."""

    order: tuple = ()
    partition: tuple = ()
    tables: dict = field(default_factory=dict)
    accumulators: dict = field(default_factory=dict)
    streaming: bool = False
    errors: list = field(default_factory=list)
    used: set = field(default_factory=set)


VERBS: dict[str, Verb] = {}


def verb(name: str, arity: int | None, kind: str = "C", *, also: tuple[str, ...] = ()):
    """Register a builder under ``name``. ``arity`` is how many operands the text form reads (None: all)."""

    def register(build):
        for n in (name, *also):
            VERBS[n] = Verb(n, arity, build, kind, (build.__doc__ or "").strip())
        return build

    return register


def need_literal(v: Value, what: str) -> Any:
    if not v.is_literal:
        raise CompileError(f"{what} must be a constant")
    return v.literal


def optional(args: tuple, i: int) -> Value | None:
    return args[i] if i < len(args) else None


def when_null(v: Value, c: Column) -> Column:
    """``c`` where ``v`` is not null."""
    return F.when(v.col.isNotNull(), c) if not v.is_null else F.lit(None)
