"""Arrays, objects, aggregates and ordered analytics over an array (relational forms: ``operators.series``)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import (
    INTEGERS, NUMBERS, VERBS, CompileError, Value, array, array_value, bool_value, common_type, const, double_value, element, is_object, item, long_value, member, need_literal, number, number0, numbers, text,
    text0, text_value, truthy, verb,
)


def name_of(v: Value) -> str:
    return str(need_literal(v, "a field's name"))


def pick(x, arr: Value, field: Value | None) -> Value:
    """A field of an item, or the item itself where it is no object or no field is named."""
    it = item(x, arr)
    return member(it, name_of(field)) if field is not None and not field.is_null and is_object(it) else it


def like(arr: Value, c) -> Value:
    return Value(c, arr.type)


def whole(v: Value | None, default: int):
    return F.coalesce(number(v).cast("int"), F.lit(default)) if v is not None and not v.is_null else F.lit(default)


#: Comparisons that ``filter`` knows (fixed values).
COMPARE = {
    "=": lambda a, b: text0(a) == text0(b), "==": lambda a, b: text0(a) == text0(b), "!=": lambda a, b: text0(a) != text0(b), "<>": lambda a, b: text0(a) != text0(b),
    "<": lambda a, b: number0(a) < number0(b), "<=": lambda a, b: number0(a) <= number0(b), ">": lambda a, b: number0(a) > number0(b), ">=": lambda a, b: number0(a) >= number0(b),
    "contains": lambda a, b: F.contains(text0(a), text0(b)), "startsWith": lambda a, b: F.startswith(text0(a), text0(b)), "endsWith": lambda a, b: F.endswith(text0(a), text0(b)),
}


@verb("filter", 4, "B")
def filter_(ctx, arr, field=None, op=None, value=None):
    a = array(arr)
    if op is None or value is None:
        return like(a, F.filter(a.col, lambda x: truthy(pick(x, a, field))))
    test = COMPARE.get(str(need_literal(op, "an operator")))

    def keep(x):
        v = pick(x, a, field)
        return truthy(v) if test is None else v.col.isNotNull() & test(v, value)

    return like(a, F.filter(a.col, keep))


def _mapped(strict):
    def build(ctx, arr, field):
        a = array(arr)
        if is_object(item(F.lit(None), a)):
            t = member(item(F.lit(None), a), name_of(field)).type
            return array_value(F.transform(a.col, lambda x: member(item(x, a), name_of(field)).col), t)
        return like(a, F.transform(a.col, lambda x: F.lit(None).cast(element(a)))) if strict else a

    return build


verb("map", 2, "B")(_mapped(False))
verb("pluck", 2, "B")(_mapped(True))


@verb("reduce", 3)
def reduce(ctx, arr, name, start):
    """Left fold by a verb's name."""
    a, f = array(arr), VERBS.get(str(need_literal(name, "a verb's name")))
    if f is None:
        raise CompileError(f"unknown verb {name.literal}")
    # The fold's type is settled by one step on the operands' types.
    first = f.build(ctx, start, item(F.lit(None).cast(element(a)), a))
    t = common_type([start, Value(first.col, first.type)])
    if isinstance(t, NUMBERS):
        t = T.LongType() if isinstance(t, INTEGERS) and isinstance(element(a), INTEGERS) else T.DoubleType()
    return Value(F.aggregate(a.col, start.col.cast(t), lambda acc, x: f.build(ctx, Value(acc, t), item(x, a)).col.cast(t)), t)


@verb("flatten", 1)
def flatten(ctx, arr):
    a = array(arr)
    return Value(F.flatten(a.col), element(a)) if isinstance(element(a), T.ArrayType) else a


@verb("distinct", 1, also=("unique",))
def distinct(ctx, arr):
    a = array(arr)
    if isinstance(element(a), T.StringType):
        return like(a, F.array_distinct(a.col))
    keys = F.transform(a.col, lambda x: text0(item(x, a)))
    return like(a, F.filter(a.col, lambda x, i: F.array_position(keys, text0(item(x, a))) == i + 1))


@verb("dedupe", 2, "W")
def dedupe(ctx, arr, field=None):
    a = array(arr)
    keys = F.transform(a.col, lambda x: text0(pick(x, a, field)))
    return like(a, F.filter(a.col, lambda x, i: (i == 0) | (F.get(keys, i) != F.get(keys, i - 1))))


def _order(a: Value, field, sign: int):
    numeric = isinstance(pick(F.lit(None), a, field).type, NUMBERS)

    def compare(x, y):
        p, q = pick(x, a, field), pick(y, a, field)
        u, v = (number(p), number(q)) if numeric else (text0(p), text0(q))
        if numeric:
            # A null sorts as an empty text: before everything.
            u, v = F.coalesce(u, F.lit(float("-inf"))), F.coalesce(v, F.lit(float("-inf")))
        return F.when(u < v, -sign).when(u > v, sign).otherwise(0)

    return compare


verb("sort", 1)(lambda ctx, arr: like(array(arr), F.array_sort(array(arr).col, _order(array(arr), None, 1))))
verb("sortDesc", 1)(lambda ctx, arr: like(array(arr), F.array_sort(array(arr).col, _order(array(arr), None, -1))))
verb("sortBy", 2)(lambda ctx, arr, field: like(array(arr), F.array_sort(array(arr).col, _order(array(arr), field, 1))))
verb("reverse", 1, "B")(lambda ctx, arr: like(array(arr), F.reverse(array(arr).col)))


@verb("at", 2, "B")
def at(ctx, arr, i):
    a, k = array(arr), whole(i, 0)
    return Value(F.get(a.col, F.when(k < 0, k + F.size(a.col)).otherwise(k)), element(a))


@verb("slice", 3)
def slice_(ctx, arr, start=None, end=None):
    a = array(arr)
    n = F.size(a.col)
    lo, hi = whole(start, 0), whole(end, 1 << 30)
    lo = F.greatest(F.when(lo < 0, lo + n).otherwise(lo), F.lit(0))
    hi = F.least(F.when(hi < 0, hi + n).otherwise(hi), n)
    return like(a, F.slice(a.col, lo + 1, F.greatest(hi - lo, F.lit(0))))


verb("take", 2, "B", also=("limit",))(lambda ctx, arr, n: like(array(arr), F.slice(array(arr).col, F.lit(1), F.greatest(whole(n, 0), F.lit(0)))))
verb("drop", 2)(lambda ctx, arr, n: like(array(arr), F.slice(array(arr).col, F.greatest(whole(n, 0), F.lit(0)) + 1, F.greatest(F.size(array(arr).col), F.lit(1)))))


@verb("chunk", 2)
def chunk(ctx, arr, n):
    a, k = array(arr), F.greatest(whole(n, 1), F.lit(1))
    count = F.ceil(F.size(a.col) / k).cast("int")
    return array_value(F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.slice(a.col, i * k + 1, k)), a.type)


@verb("zip", 2)
def zip_(ctx, *arrs):
    many = [array(a) for a in arrs]
    t = common_type([item(F.lit(None), a) for a in many])
    n = F.greatest(F.lit(0), *[F.size(a.col) for a in many])
    rows = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return array_value(F.transform(rows, lambda i: F.array(*[F.get(a.col, i).cast(t) for a in many])), T.ArrayType(t))


@verb("concatArrays", 2)
def concat_arrays(ctx, *parts):
    arrs = [p if isinstance(p.type, T.ArrayType) else array_value(F.when(p.col.isNull(), F.array().cast(T.ArrayType(p.type))).otherwise(F.array(p.col)), p.type) for p in parts if not p.is_null]
    t = common_type([item(F.lit(None), a) for a in arrs])
    return array_value(F.concat(*[F.coalesce(a.col.cast(T.ArrayType(t)), F.array().cast(T.ArrayType(t))) for a in arrs]), t)


verb("compact", 1)(lambda ctx, arr: like(array(arr), F.filter(array(arr).col, lambda x: x.isNotNull() & (text0(item(x, array(arr))) != ""))))


def _keys(arr):
    a = array(arr)
    return F.transform(a.col, lambda x: text0(item(x, a)))


verb("indexOf", 2)(lambda ctx, arr, v: long_value(F.array_position(_keys(arr), text0(v)) - 1))
verb("includes", 2)(lambda ctx, arr, v: bool_value(F.array_contains(_keys(arr), text0(v))))


def _test(arr, field):
    a = array(arr)
    return a, (lambda x: truthy(pick(x, a, field)))


@verb("every", 4)
def every(ctx, arr, field=None, *_):
    a, test = _test(arr, field)
    return bool_value(F.forall(a.col, test))


@verb("some", 4)
def some(ctx, arr, field=None, *_):
    a, test = _test(arr, field)
    return bool_value(F.exists(a.col, test))


@verb("find", 4)
def find(ctx, arr, field=None, *_):
    a, test = _test(arr, field)
    return Value(F.get(F.filter(a.col, test), F.lit(0)), element(a))


@verb("findIndex", 4)
def find_index(ctx, arr, field=None, *_):
    a, test = _test(arr, field)
    return long_value(F.array_position(F.transform(a.col, test), F.lit(True)) - 1)


@verb("partition", 4)
def partition(ctx, arr, field=None, *_):
    a, test = _test(arr, field)
    return array_value(F.array(F.filter(a.col, test), F.filter(a.col, lambda x: ~test(x))), a.type)


@verb("groupBy", 2, "A")
def group_by(ctx, arr, field):
    a = array(arr)
    key = lambda x: text0(pick(x, a, field))
    names = F.array_distinct(F.transform(a.col, key))
    groups = F.transform(names, lambda k: F.struct(k.alias("key"), F.filter(a.col, lambda x: key(x) == k).alias("value")))
    return Value(F.map_from_entries(groups), T.MapType(T.StringType(), a.type))


@verb("pivot", 3)
def pivot(ctx, arr, key, value):
    """Key to value; of equal keys the last counts, null keys don't."""
    a = array(arr)
    t = pick(F.lit(None), a, value).type
    known = F.filter(a.col, lambda x: pick(x, a, key).col.isNotNull())
    names = F.array_distinct(F.transform(known, lambda x: text0(pick(x, a, key))))
    last = lambda k: F.element_at(F.filter(known, lambda x: text0(pick(x, a, key)) == k), -1)
    return Value(F.map_from_entries(F.transform(names, lambda k: F.struct(k.alias("key"), pick(last(k), a, value).col.alias("value")))), T.MapType(T.StringType(), t))


def as_map(v: Value) -> Value:
    """An object as a map; values of unlike types meet as texts."""
    if isinstance(v.type, T.MapType):
        return v
    if isinstance(v.type, T.StructType):
        fields = [member(v, n) for n in v.type.names]
        t = common_type(fields)
        pairs = [c for n, f in zip(v.type.names, fields, strict=True) for c in (F.lit(n), text(f) if isinstance(t, T.StringType) else f.col.cast(t))]
        return Value(F.when(v.col.isNotNull(), F.create_map(*pairs)), T.MapType(T.StringType(), t))
    if isinstance(v.type, T.StringType):
        return Value(F.from_json(v.col, "map<string,string>"), T.MapType(T.StringType(), T.StringType()))
    return Value(F.lit(None).cast("map<string,string>"), T.MapType(T.StringType(), T.StringType()))


@verb("unpivot", 3)
def unpivot(ctx, obj, k, v):
    m = as_map(obj)
    kn, vn = name_of(k), name_of(v)
    t = T.StructType([T.StructField(kn, T.StringType()), T.StructField(vn, m.type.valueType)])
    return array_value(F.transform(F.map_entries(m.col), lambda e: F.struct(e.key.alias(kn), e.value.alias(vn))), t)


@verb("range", 3)
def range_(ctx, *args):
    """Whole numbers from a start to before an end, 10000 at most."""
    start, end = (F.lit(0), whole(args[0], 0)) if len(args) == 1 else (whole(args[0], 0), whole(args[1], 0))
    step = whole(args[2], 1) if len(args) > 2 else F.lit(1)
    last = end - F.signum(step).cast("int")
    some_ = F.when(step > 0, start < end).when(step < 0, start > end).otherwise(F.lit(False))
    last = F.when(step > 0, F.least(last, start + step * 9999)).otherwise(F.greatest(last, start + step * 9999))
    return array_value(F.transform(F.when(some_, F.sequence(start, last, step)).otherwise(F.array().cast("array<int>")), lambda x: x.cast("long")), T.LongType())


@verb("sample", 3, "U")
def sample(ctx, arr, n, seed=None):
    a = array(arr)
    if seed is None or seed.is_null:
        return like(a, F.slice(F.shuffle(a.col), F.lit(1), F.greatest(whole(n, 0), F.lit(0))))
    from .numerics import Mulberry, _seed

    start = _seed(str(seed.literal)) if isinstance(need_literal(seed, "a seed"), str) else int(seed.literal)

    @F.pandas_udf("array<int>")
    def order(sizes: pd.Series) -> pd.Series:
        def one(k):
            draw, places = Mulberry(start), list(range(max(int(k), 0)))
            for i in range(len(places) - 1, 0, -1):
                j = int(draw.next() * (i + 1))
                places[i], places[j] = places[j], places[i]
            return places

        return sizes.map(one)

    picked = F.slice(order(F.size(a.col)), F.lit(1), F.greatest(whole(n, 0), F.lit(0)))
    return like(a, F.transform(picked, lambda i: F.get(a.col, i)))


# Ordered analytics


def _numbers(arr):
    a = array(arr)
    return F.transform(a.col, lambda x: number(item(x, a)))


def _running(start: float, step):
    def build(ctx, arr):
        xs = _numbers(arr)
        none = F.array().cast("array<double>")
        state = F.struct(F.lit(start).alias("t"), none.alias("out"))
        got = F.aggregate(xs, state, lambda s, x: F.struct(F.when(x.isNull(), s.t).otherwise(step(s.t, x)).alias("t"), F.concat(s.out, F.array(F.when(x.isNotNull(), step(s.t, x)))).alias("out")))
        return array_value(got.getField("out"), T.DoubleType())

    return build


verb("cumsum", 1, "W")(_running(0.0, lambda t, x: t + x))
verb("cumprod", 1, "W")(_running(1.0, lambda t, x: t * x))


def _against(f):
    def build(ctx, arr, n=None):
        xs, k = _numbers(arr), whole(n, 1)
        return array_value(F.transform(xs, lambda x, i: F.when(i >= k, f(x, F.get(xs, i - k)))), T.DoubleType())

    return build


verb("diff", 2, "W")(_against(lambda x, p: x - p))
verb("pctChange", 2, "W")(_against(lambda x, p: F.try_divide(x - p, p)))


def _shifted(way: int):
    def build(ctx, arr, n=None, fill=None):
        a, k = array(arr), whole(n, 1) * way
        t = element(a) if fill is None or fill.is_null else common_type([item(F.lit(None), a), fill])
        rest = F.lit(None).cast(t) if fill is None or fill.is_null else fill.col.cast(t)
        size = F.size(a.col)
        return array_value(F.transform(a.col, lambda _, i: F.when((i - k >= 0) & (i - k < size), F.get(a.col, i - k).cast(t)).otherwise(rest)), t)

    return build


verb("shift", 3, "W")(_shifted(1))
verb("lag", 3, "W")(_shifted(1))
verb("lead", 3, "W")(_shifted(-1))


@verb("rank", 3, "W")
def rank(ctx, arr, field=None, direction=None):
    """Dense rank of numbers, the largest first unless ``asc``; others get null."""
    a = array(arr)
    named = field is not None and not field.is_null and field.literal not in ("asc", "desc", "")
    xs = F.transform(a.col, lambda x: number(pick(x, a, field if named else None)))
    way = next((str(v.literal) for v in (direction, field) if v is not None and v.is_literal and v.literal in ("asc", "desc")), "desc")
    steps = F.array_sort(F.array_distinct(F.filter(xs, lambda x: x.isNotNull())))
    steps = steps if way == "asc" else F.reverse(steps)
    return array_value(F.transform(xs, lambda x: F.when(x.isNotNull(), F.array_position(steps, x))), T.LongType())


@verb("fillMissing", 3, "W")
def fill_missing(ctx, arr, strategy=None, fill=None):
    a = array(arr)
    how = str(need_literal(strategy, "a strategy")) if strategy is not None and not strategy.is_null else "constant"
    size = F.size(a.col)
    known = lambda s: F.filter(s, lambda x: x.isNotNull())
    if how in ("forward", "ffill"):
        return like(a, F.transform(a.col, lambda x, i: F.coalesce(x, F.element_at(F.concat(F.array(F.lit(None).cast(element(a))), known(F.slice(a.col, F.lit(1), i + 1))), -1))))
    if how in ("backward", "bfill"):
        return like(a, F.transform(a.col, lambda x, i: F.coalesce(x, F.get(known(F.slice(a.col, i + 1, size)), F.lit(0)))))
    value = fill if fill is not None and not fill.is_null else const(0)
    return like(a, F.transform(a.col, lambda x: F.coalesce(x, value.col.cast(element(a)))))


@verb("movingAvg", 2, "W")
def moving_average(ctx, arr, n):
    xs, k = F.transform(_numbers(arr), lambda x: F.coalesce(x, F.lit(0.0))), F.greatest(whole(n, 1), F.lit(1))

    def mean(_, i):
        first = F.greatest(i - k + 1, F.lit(0))
        part = F.slice(xs, first + 1, i - first + 1)
        return F.aggregate(part, F.lit(0.0), lambda s, x: s + x) / F.size(part)

    return array_value(F.transform(xs, mean), T.DoubleType())


# Aggregates and statistics


def total(xs):
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


@verb("sum", 1, "A")
def sum_(ctx, arr):
    c = F.coalesce(total(numbers(arr)), F.lit(0.0))
    return long_value(c) if isinstance(element(array(arr)), INTEGERS) else double_value(c)


@verb("count", 1, "A")
def count(ctx, v):
    if isinstance(v.type, T.ArrayType):
        return long_value(F.coalesce(F.size(v.col), F.lit(0)))
    return long_value(F.when(v.col.isNull(), 0).otherwise(1))


def _back(arr, c):
    return long_value(c) if isinstance(element(array(arr)), INTEGERS) else double_value(c)


verb("min", 1, "A")(lambda ctx, arr: _back(arr, F.array_min(numbers(arr))))
verb("max", 1, "A")(lambda ctx, arr: _back(arr, F.array_max(numbers(arr))))
verb("avg", 1, "A")(lambda ctx, arr: double_value(mean(numbers(arr))))
verb("first", 1, "A")(lambda ctx, arr: Value(F.get(array(arr).col, F.lit(0)), element(array(arr))))
verb("last", 1, "A")(lambda ctx, arr: Value(F.get(array(arr).col, F.size(array(arr).col) - 1), element(array(arr))))


def mean(xs):
    return F.try_divide(total(xs), F.size(xs))


def spread(xs, less: int):
    m = mean(xs)
    return F.when(F.size(xs) > less, F.try_divide(total(F.transform(xs, lambda x: (x - m) * (x - m))), F.size(xs) - less))


verb("variance", 1, "A")(lambda ctx, arr: double_value(spread(numbers(arr), 0)))
verb("varianceSample", 1, "A")(lambda ctx, arr: double_value(spread(numbers(arr), 1)))
verb("std", 1, "A")(lambda ctx, arr: double_value(F.sqrt(spread(numbers(arr), 0))))
verb("stdSample", 1, "A")(lambda ctx, arr: double_value(F.sqrt(spread(numbers(arr), 1))))


def at_share(xs, q):
    """Linear interpolation between order statistics."""
    s = F.array_sort(xs)
    place = q * (F.size(s) - 1)
    lo = F.floor(place).cast("int")
    a, b = F.get(s, lo), F.get(s, F.ceil(place).cast("int"))
    return F.when(F.size(s) > 0, a + (b - a) * (place - lo))


verb("median", 1, "A")(lambda ctx, arr: double_value(at_share(numbers(arr), F.lit(0.5))))
verb("percentile", 2, "A")(lambda ctx, arr, p: double_value(at_share(numbers(arr), number(p) / 100)))
verb("quantile", 2, "A")(lambda ctx, arr, q: double_value(at_share(numbers(arr), number(q))))


@verb("mode", 1, "A")
def mode(ctx, arr):
    """The most frequent item by its text; of equal counts the one seen first."""
    a = array(arr)
    keys = F.transform(a.col, lambda x: text0(item(x, a)))
    counts = F.transform(keys, lambda k: F.size(F.filter(keys, lambda o: o == k)))
    return Value(F.get(a.col, (F.array_position(counts, F.array_max(counts)) - 1).cast("int")), element(a))


def _sides(a, b):
    xs, ys = _numbers(a), _numbers(b)
    n = F.least(F.size(xs), F.size(ys))
    where = F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.get(xs, i).isNotNull() & F.get(ys, i).isNotNull())
    return F.transform(where, lambda i: F.get(xs, i)), F.transform(where, lambda i: F.get(ys, i))


def _cov(xs, ys):
    mx, my = mean(xs), mean(ys)
    return F.try_divide(total(F.zip_with(xs, ys, lambda x, y: (x - mx) * (y - my))), F.size(xs))


@verb("covariance", 2, "A")
def covariance(ctx, a, b):
    return double_value(_cov(*_sides(a, b)))


@verb("correlation", 2, "A")
def correlation(ctx, a, b):
    xs, ys = _sides(a, b)
    d = F.sqrt(spread(xs, 0) * spread(ys, 0))
    return double_value(F.when(d >= 1e-15, F.try_divide(_cov(xs, ys), d)))


@verb("weightedAvg", 2, "A")
def weighted_average(ctx, values, weights):
    zero = lambda arr: F.transform(_numbers(arr), lambda x: F.coalesce(x, F.lit(0.0)))
    xs, ws = zero(values), zero(weights)
    n = F.least(F.size(xs), F.size(ws))
    ws = F.slice(ws, F.lit(1), n)
    return double_value(F.try_divide(total(F.zip_with(F.slice(xs, F.lit(1), n), ws, lambda x, w: x * w)), total(ws)))


# Objects


@verb("keys", 1)
def keys(ctx, obj):
    return array_value(F.map_keys(as_map(obj).col), T.StringType())


@verb("values", 1)
def values(ctx, obj):
    m = as_map(obj)
    return array_value(F.map_values(m.col), m.type.valueType)


@verb("entries", 1)
def entries(ctx, obj):
    m = as_map(obj)
    return array_value(F.transform(F.map_entries(m.col), lambda e: F.array(e.key, text0(Value(e.value, m.type.valueType)))), T.ArrayType(T.StringType()))


@verb("has", 2)
def has(ctx, obj, key):
    if isinstance(obj.type, T.StructType) and key.is_literal:
        return bool_value(obj.col.isNotNull() & F.lit(key.literal in obj.type.names))
    return bool_value(F.coalesce(F.map_contains_key(as_map(obj).col, text0(key)), F.lit(False)))


@verb("get", 3)
def get(ctx, obj, key, default=None):
    rest = default if default is not None else const(None)
    if isinstance(obj.type, T.StructType) and key.is_literal:
        return member(obj, str(key.literal)) if key.literal in obj.type.names else rest
    m = as_map(obj)
    t = common_type([Value(F.lit(None), m.type.valueType), rest])
    found = F.try_element_at(m.col, text0(key)).cast(t)
    return Value(F.when(F.map_contains_key(m.col, text0(key)), found).otherwise(rest.col.cast(t)), t)


def _later_wins(a, b):
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


@verb("merge", 2)
def merge(ctx, *objs):
    maps = [as_map(o) for o in objs if not o.is_null]
    t = common_type([Value(F.lit(None), m.type.valueType) for m in maps])
    cast = [F.coalesce(m.col.cast(T.MapType(T.StringType(), t)), F.create_map().cast(T.MapType(T.StringType(), t))) for m in maps]
    out = cast[0]
    for m in cast[1:]:
        out = _later_wins(out, m)
    return Value(out, T.MapType(T.StringType(), t))


@verb("jsonPath", 2)
def json_path(ctx, v, path):
    p = str(need_literal(path, "a path"))
    source = v.col if isinstance(v.type, T.StringType) else F.to_json(v.col)
    return text_value(F.get_json_object(source, p if p.startswith("$") else f"$.{p}"))


@verb("extract", 3)
def extract(ctx, obj, names, *_):
    wanted = [n.strip() for n in str(need_literal(names, "field names")).split(",")]
    if isinstance(obj.type, T.StructType):
        fields = [n for n in wanted if n in obj.type.names]
        return Value(F.struct(*[obj.col.getField(n).alias(n) for n in fields]), T.StructType([obj.type[n] for n in fields])) if fields else const(None)
    m = as_map(obj)
    return Value(F.map_filter(m.col, lambda k, _: k.isin(*wanted)), m.type)
