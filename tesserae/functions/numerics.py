"""Arithmetic, rounding, formatting, units, finance and geography."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import Value, array, bool_value, const, double_value, item, long_value, need_literal, number, number0, numbers, numeric_type, text, text0, text_value, verb

INF = float("inf")


def finite(c):
    return F.when(F.isnan(c) | (F.abs(c) == INF), F.lit(None)).otherwise(c)


def by_type(c, *operands):
    """A result that is whole if all operands are."""
    return Value(c.cast("long"), T.LongType()) if isinstance(numeric_type(*operands), T.LongType) else double_value(c)


def math(f):
    return lambda ctx, v, *_: double_value(finite(f(number(v))))


verb("add", 2)(lambda ctx, a, b: by_type(number(a) + number(b), a, b))
verb("subtract", 2)(lambda ctx, a, b: by_type(number(a) - number(b), a, b))
verb("multiply", 2)(lambda ctx, a, b: by_type(number(a) * number(b), a, b))
verb("divide", 2)(lambda ctx, a, b: double_value(F.try_divide(number(a), number(b))))
verb("safeDivide", 3)(lambda ctx, a, b, d: double_value(F.coalesce(F.try_divide(F.coalesce(number(a), F.lit(0.0)), number(b)), number(d))))


@verb("mod", 2)
def mod(ctx, a, b):
    """Floored modulo of the operands cut to whole numbers; the sign is the divisor's."""
    x, y = number(a).cast("long"), number(b).cast("long")
    return long_value(F.when(y != 0, x - y * F.floor(F.try_divide(x.cast("double"), y.cast("double")))))


verb("abs", 1, "B")(lambda ctx, v: by_type(F.abs(number(v)), v))
verb("negate", 1, "B")(lambda ctx, v: by_type(-number(v), v))
verb("sign", 1)(lambda ctx, v: long_value(F.signum(number(v))))
verb("floor", 1, "B")(lambda ctx, v: long_value(F.floor(number(v))))
verb("ceil", 1, "B")(lambda ctx, v: long_value(F.ceil(number(v))))
verb("trunc", 1)(lambda ctx, v: long_value(number(v)))


def places(v, default=0):
    return int(need_literal(v, "decimal places") or 0) if v is not None and not v.is_null else default


def rounded(v, n):
    return F.round(number(v), n)


@verb("round", 2, "B")
def round_(ctx, v, n=None):
    p = places(n)
    if p < 0:
        return double_value(number(v))
    return long_value(rounded(v, 0)) if p == 0 else double_value(rounded(v, p))


def _extreme(pick):
    def build(ctx, *args):
        parts = [numbers(a) if isinstance(a.type, T.ArrayType) else F.array(number(a)) for a in args]
        every = F.filter(F.concat(*parts), lambda x: x.isNotNull())
        return double_value(pick(every))

    return build


verb("minOf", None)(_extreme(F.array_min))
verb("maxOf", None)(_extreme(F.array_max))


@verb("clamp", 3)
def clamp(ctx, v, lo, hi):
    a, b, c = number(v), number(lo), number(hi)
    return by_type(F.when(a.isNotNull() & b.isNotNull() & c.isNotNull(), F.least(F.greatest(a, b), c)), v, lo, hi)


verb("pow", 2)(lambda ctx, a, b: double_value(finite(F.pow(number(a), number(b)))))
verb("sqrt", 1)(lambda ctx, v: double_value(F.when(number(v) >= 0, F.sqrt(number(v)))))
verb("exp", 1)(math(F.exp))
verb("ln", 1)(lambda ctx, v: double_value(F.when(number(v) > 0, F.ln(number(v)))))
verb("log10", 1)(lambda ctx, v: double_value(F.when(number(v) > 0, F.log10(number(v)))))


@verb("log", 2)
def log(ctx, v, base):
    x, b = number(v), number(base)
    return double_value(F.when((x > 0) & (b > 0) & (b != 1), F.ln(x) / F.ln(b)))


verb("isFinite", 1)(lambda ctx, v: bool_value(F.coalesce(~F.isnan(number(v)) & (F.abs(number(v)) < INF), F.lit(False))))
verb("isNaN", 1)(lambda ctx, v: bool_value(number(v).isNull() | F.isnan(number(v))))


@verb("parseInt", 2)
def parse_int(ctx, s, radix=None):
    """The whole number that a text begins with, in a radix of 2 to 36; 0 if there is none."""
    r = places(radix, 10)
    if not 2 <= r <= 36:
        return const(None)
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"[:r]
    found = F.regexp_extract(F.lower(F.btrim(text0(s))), f"^([+-]?[{digits}]+)", 1)
    sign = F.when(F.startswith(found, F.lit("-")), F.lit(-1)).otherwise(F.lit(1))
    value = F.coalesce(F.conv(F.regexp_replace(found, "^[+-]", ""), r, 10).try_cast("long"), F.lit(0))
    return long_value(F.when(text(s).isNotNull(), sign * F.when(found == "", F.lit(0)).otherwise(value)))


def fixed_text(v, n, *, factor=1):
    x = number(v) if factor == 1 else number(v) * factor
    return F.when(x.isNotNull(), F.format_string(f"%.{n}f", F.round(x, n)))


verb("formatNumber", 2)(lambda ctx, v, n=None: text_value(fixed_text(v, places(n))))
verb("formatInteger", 1)(lambda ctx, v: text_value(fixed_text(v, 0)))
verb("formatCurrency", 1)(lambda ctx, v: text_value(fixed_text(v, 2)))
verb("formatPercent", 2)(lambda ctx, v, n=None: text_value(F.concat(fixed_text(v, places(n), factor=100), F.lit("%"))))
verb("formatLocaleNumber", 2, "B")(lambda ctx, v, n=None: text_value(F.format_number(F.round(number(v), places(n, 2)), places(n, 2))))

#: Units by family, in terms of the family's first (fixed values).
UNITS = {
    "mass": {"g": 1.0, "kg": 1000.0, "mg": 0.001, "lb": 453.592, "oz": 28.3495, "ton": 907185.0, "tonne": 1000000.0},
    "length": {"m": 1.0, "km": 1000.0, "cm": 0.01, "mm": 0.001, "mi": 1609.344, "yd": 0.9144, "ft": 0.3048, "in": 0.0254},
    "volume": {"l": 1.0, "ml": 0.001, "gal": 3.78541, "qt": 0.946353, "pt": 0.473176, "cup": 0.236588, "floz": 0.0295735},
    "speed": {"m/s": 1.0, "km/h": 0.277778, "mph": 0.44704, "knot": 0.514444, "ft/s": 0.3048},
    "area": {"m2": 1.0, "km2": 1000000.0, "cm2": 0.0001, "ha": 10000.0, "acre": 4046.86, "ft2": 0.092903, "in2": 0.00064516, "mi2": 2589988.0},
    "data": {"B": 1.0, "KB": 1024.0, "MB": 1048576.0, "GB": 1073741824.0, "TB": 1099511627776.0},
    "time": {"s": 1.0, "ms": 0.001, "min": 60.0, "h": 3600.0, "d": 86400.0, "wk": 604800.0},
}


@verb("convertUnit", 3)
def convert_unit(ctx, v, old, new):
    a, b = str(need_literal(old, "a unit")), str(need_literal(new, "a unit"))
    x = number(v)
    to_celsius = {"C": lambda c: c, "F": lambda c: (c - 32) * 5.0 / 9.0, "K": lambda c: c - 273.15}
    of_celsius = {"C": lambda c: c, "F": lambda c: c * 9.0 / 5.0 + 32, "K": lambda c: c + 273.15}
    if a in to_celsius and b in of_celsius:
        return double_value(F.round(of_celsius[b](to_celsius[a](x)), 6))
    family = next((u for u in UNITS.values() if a in u and b in u), None)
    return const(None) if family is None else double_value(F.round(x * family[a] / family[b], 6))


def _seed(text_: str) -> int:
    """A text's 32-bit seed: the hash 31 h + c over its characters."""
    h = 0
    for c in text_:
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    return h


class Mulberry:
    """The Mulberry32 generator."""

    def __init__(self, seed: int):
        self.state = seed & 0xFFFFFFFF

    def next(self) -> float:
        self.state = (self.state + 0x6D2B79F5) & 0xFFFFFFFF
        t = self.state
        t = ((t ^ t >> 15) * (t | 1)) & 0xFFFFFFFF
        t ^= (t + ((t ^ t >> 7) * (t | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF
        return ((t ^ t >> 14) & 0xFFFFFFFF) / 4294967296


@verb("random", 3)
def random(ctx, *args):
    """Unseeded, or the first draw of a generator seeded by a constant text."""
    if args and isinstance(args[-1].type, T.StringType):
        draw = Mulberry(_seed(str(need_literal(args[-1], "a seed")))).next()
        if len(args) < 3:
            return const(draw)
        lo, hi = number0(args[0]).cast("long"), number0(args[1]).cast("long")
        return long_value(lo + F.floor(F.lit(draw) * (hi - lo + 1)))
    if len(args) >= 2:
        lo, hi = number0(args[0]), number0(args[1])
        return double_value(F.round(lo + F.rand() * (hi - lo), places(args[2], 2) if len(args) > 2 else 2))
    return double_value(F.rand())


# Finance


def closed(*names):
    """A closed formula over doubles; not finite is null."""

    def register(f):
        def build(ctx, *args):
            xs = [number(a) for a in args[: len(names) - 1]]
            return double_value(finite(f(*xs)))

        verb(names[0], len(names) - 1)(build)
        return f

    return register


@closed("compound", "p", "r", "n")
def _compound(p, r, n):
    return p * F.pow(1 + r, n)


@closed("discount", "fv", "r", "n")
def _discount(fv, r, n):
    return F.try_divide(fv, F.pow(1 + r, n))


@closed("pmt", "p", "r", "n")
def _pmt(p, r, n):
    g = F.pow(1 + r, n)
    return F.when(r == 0, F.try_divide(p, n)).otherwise(F.try_divide(p * r * g, g - 1))


@closed("fv", "pmt", "r", "n")
def _fv(pmt, r, n):
    return F.when(r == 0, pmt * n).otherwise(F.try_divide(pmt * (F.pow(1 + r, n) - 1), r))


@closed("pv", "pmt", "r", "n")
def _pv(pmt, r, n):
    return F.when(r == 0, pmt * n).otherwise(F.try_divide(pmt * (1 - F.pow(1 + r, -n)), r))


@closed("depreciation", "cost", "salvage", "life")
def _depreciation(cost, salvage, life):
    return F.try_divide(cost - salvage, life)


@verb("nper", 4)
def nper(ctx, rate, pmt, pv, *_):
    r, p, v = number(rate), number(pmt), number(pv)
    inner = F.try_divide(p, p + r * v)
    base = F.when(r > -1, F.ln(F.when(r > -1, 1 + r)))
    general = F.when(inner > 0, F.try_divide(F.ln(F.when(inner > 0, inner)), base))
    return double_value(finite(F.when(r == 0, -F.try_divide(v, p)).otherwise(general)))


@verb("npv", 2, "A")
def npv(ctx, rate, flows):
    r, a = number(rate), array(flows)
    terms = F.transform(a.col, lambda x, i: F.try_divide(F.coalesce(number(item(x, a)), F.lit(0.0)), F.pow(1 + r, i)))
    return double_value(finite(F.when(F.size(a.col) > 0, F.aggregate(terms, F.lit(0.0), lambda s, x: s + x))))


def newton(step, start: np.ndarray, rounds=100, tolerance=1e-10) -> np.ndarray:
    """Newton's method on all rows of a batch at once; NaN where the slope is flat or nothing converges.

    ``step`` gives values and slopes at the points of the rows (given by number) that are still on their way.
    """
    out = np.full(len(start), np.nan)
    rows = np.flatnonzero(np.isfinite(start))
    x = start[rows]
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            if not len(rows):
                break
            f, slope = step(x, rows)
            new = x - f / slope
            going = np.isfinite(new) & (np.abs(slope) >= 1e-15)
            there = going & (np.abs(new - x) < tolerance)
            out[rows[there]] = new[there]
            x, rows = new[going & ~there], rows[going & ~there]
    return out


@verb("irr", 2, "U")
def irr(ctx, flows, guess=None):
    a = array(flows)
    start = number(guess) if guess is not None and not guess.is_null else F.lit(0.1)

    @F.pandas_udf("double")
    def solve(cash: pd.Series, first: pd.Series) -> pd.Series:
        sizes = np.array([0 if c is None else len(c) for c in cash])
        # Rows of a batch as one table, filled up with zeros.
        table = np.zeros((len(sizes), max(1, sizes.max(initial=0))))
        table[np.arange(table.shape[1]) < sizes[:, None]] = np.concatenate([np.zeros(0), *[c for c in cash if c is not None]])
        i = np.arange(table.shape[1])

        def step(r, rows):
            terms = table[rows] * (1 + r)[:, None] ** -i
            return terms.sum(1), (-i * terms).sum(1) / (1 + r)

        return pd.Series(newton(step, np.where(sizes > 0, first.to_numpy(float), np.nan)))

    return double_value(_nan_as_null(solve(F.transform(a.col, lambda x: F.coalesce(number(item(x, a)), F.lit(0.0))), F.coalesce(start, F.lit(0.1)))))


@verb("rate", 4, "U")
def rate(ctx, periods, pmt, pv, fv=None):
    @F.pandas_udf("double")
    def solve(n: pd.Series, p: pd.Series, v: pd.Series, w: pd.Series) -> pd.Series:
        n, p, v, w = (x.to_numpy(float) for x in (n, p, v, w))

        def step(r, rows):
            a, b, c, d = n[rows], p[rows], v[rows], w[rows]
            g, g1 = (1 + r) ** a, (1 + r) ** (a - 1)
            return c * g + b * (g - 1) / r + d, c * a * g1 + b * (a * g1 * r - (g - 1)) / (r * r)

        return pd.Series(newton(step, np.where(np.isnan(n + p + v), np.nan, 0.1)))

    future = number0(fv) if fv is not None else F.lit(0.0)
    return double_value(_nan_as_null(solve(number(periods), number(pmt), number(pv), future)))


def _nan_as_null(c):
    return F.when(~F.isnan(c), c)


verb("zscore", 2)(lambda ctx, v, mean, sd=None: double_value(F.try_divide(number(v) - number(mean), number(sd))) if sd is not None else _zscore_array(v, mean))


def _zscore_array(v, values):
    """Of a value among an array's numbers: their mean and population deviation."""
    xs = numbers(values)
    n = F.size(xs)
    mean = F.try_divide(F.aggregate(xs, F.lit(0.0), lambda s, x: s + x), n)
    spread = F.sqrt(F.try_divide(F.aggregate(F.transform(xs, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda s, x: s + x), n))
    return double_value(F.try_divide(number(v) - mean, spread))


verb("interpolate", 5)(lambda ctx, a, b, t, *_: double_value(number(a) + (number(b) - number(a)) * number(t)))


# Geography

EARTH_KM = 6371.0
#: Kilometres in other units of distance (fixed values).
PER_KM = {"km": 1.0, "mi": 0.621371, "miles": 0.621371, "nm": 0.539957}


def radians(*vs):
    return [F.radians(number(v)) for v in vs]


@verb("distance", 5)
def distance(ctx, lat1, lon1, lat2, lon2, unit=None):
    name = str(need_literal(unit, "a unit")) if unit is not None and not unit.is_null else "km"
    if name not in PER_KM:
        ctx.errors.append(F.lit(f"T011: incompatible unit {name}"))
        return const(None)
    a, o, b, p = radians(lat1, lon1, lat2, lon2)
    h = F.pow(F.sin((b - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(b) * F.pow(F.sin((p - o) / 2), F.lit(2.0))
    return double_value(2 * EARTH_KM * F.atan2(F.sqrt(h), F.sqrt(1 - h)) * PER_KM[name])


@verb("inBoundingBox", 6)
def in_box(ctx, lat, lon, lat0, lon0, lat1, lon1):
    y, x, s, w, n, e = (number(v) for v in (lat, lon, lat0, lon0, lat1, lon1))
    known = F.greatest(*[c.isNull().cast("int") for c in (y, x, s, w, n, e)]) == 0
    return bool_value(F.when(known, y.between(s, n) & x.between(w, e)))


verb("toRadians", 1, "B")(lambda ctx, v: double_value(F.radians(number(v))))
verb("toDegrees", 1, "B")(lambda ctx, v: double_value(F.degrees(number(v))))


@verb("bearing", 4)
def bearing(ctx, lat1, lon1, lat2, lon2):
    a, o, b, p = radians(lat1, lon1, lat2, lon2)
    y, x = F.sin(p - o) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(p - o)
    return double_value(F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0)))


@verb("midpoint", 4)
def midpoint(ctx, lat1, lon1, lat2, lon2):
    a, o, b, p = radians(lat1, lon1, lat2, lon2)
    x, y = F.cos(b) * F.cos(p - o), F.cos(b) * F.sin(p - o)
    lat = F.degrees(F.atan2(F.sin(a) + F.sin(b), F.sqrt((F.cos(a) + x) * (F.cos(a) + x) + y * y)))
    lon = F.degrees(o + F.atan2(y, F.cos(a) + x))
    return Value(F.struct(lat.alias("lat"), lon.alias("lon")), T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]))
