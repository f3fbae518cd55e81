"""Dates and times. Dates are read leniently from ISO texts and a few other forms; the session's zone is UTC."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import NUMBERS, Value, bool_value, const, long_value, need_literal, number, text, text0, text_value, verb

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
#: Forms tried after ISO, in order (fixed values).
FORMS = ("yyyy/MM/dd", "MMM d, yyyy", "MMM d yyyy", "d MMM yyyy", "MMMM d, yyyy", "d MMMM yyyy")


def moment(v: Value):
    """The point in time of a value, null if it has none."""
    if isinstance(v.type, (T.TimestampType, T.DateType)):
        return v.col.cast("timestamp")
    if isinstance(v.type, T.TimestampNTZType):
        return v.col.cast("timestamp")
    if not isinstance(v.type, T.StringType):
        return F.lit(None).cast("timestamp")
    s = F.btrim(v.col)
    iso = F.when(F.regexp_like(s, F.lit(r"^\d{4}-\d{1,2}-\d{1,2}([T ].*)?$")), s.try_cast("timestamp"))
    return F.coalesce(iso, *[F.try_to_timestamp(s, F.lit(f)) for f in FORMS])


def day(v: Value):
    if isinstance(v.type, T.DateType):
        return v.col
    return moment(v).cast("date")


def is_moment(v: Value):
    """Whether a value carries a time of day."""
    if isinstance(v.type, (T.TimestampType, T.TimestampNTZType)):
        return F.lit(True)
    return F.contains(v.col, F.lit("T")) if isinstance(v.type, T.StringType) else F.lit(False)


def stamp(c) -> Value:
    return text_value(F.date_format(c, ISO))


def iso_day(c) -> Value:
    return text_value(c.cast("date").cast("string"))


verb("today", 0, "B")(lambda ctx: Value(F.current_date(), T.DateType()))
verb("now", 0, "B")(lambda ctx: Value(F.date_trunc("millisecond", F.current_timestamp()), T.TimestampType()))

#: Pieces of a pattern and how Spark writes them; longer pieces first (fixed values).
PIECES = (("YYYY", "yyyy"), ("yyyy", "yyyy"), ("YY", "yy"), ("yy", "yy"), ("MMMM", "MMMM"), ("MMM", "MMM"), ("MM", "MM"), ("DD", "dd"), ("dd", "dd"), ("EEEE", "EEEE"), ("EEE", "EEE"), ("HH", "HH"), ("hh", "hh"), ("mm", "mm"), ("SSS", "SSS"), ("ss", "ss"), ("A", "a"))


def spark_pattern(pattern: str) -> str:
    known = dict(PIECES)
    out = []
    for m in re.finditer("|".join(p for p, _ in PIECES) + "|.", pattern, re.S):
        out.append(known.get(m[0]) or ("''" if m[0] == "'" else f"'{m[0]}'"))
    return "".join(out).replace("''''", "''")


def formatted(c, pattern: str):
    # Neighbouring quoted signs are one quoted run.
    return F.date_format(c, re.sub(r"(?<=[^'])''(?=[^'])", "", spark_pattern(pattern)))


@verb("formatDate", 2)
def format_date(ctx, d, pattern):
    return text_value(formatted(moment(d), str(need_literal(pattern, "a pattern"))))


@verb("formatTime", 2)
def format_time(ctx, t, pattern=None):
    return text_value(formatted(moment(t), str(need_literal(pattern, "a pattern")) if pattern is not None and not pattern.is_null else "HH:mm:ss"))


@verb("formatTimestamp", 2)
def format_timestamp(ctx, t, pattern=None):
    if pattern is None or pattern.is_null:
        return stamp(moment(t))
    return text_value(formatted(moment(t), str(need_literal(pattern, "a pattern"))))


@verb("parseDate", 2)
def parse_date(ctx, s, pattern=None):
    """A date by the places of its year, month and day in a pattern; an ISO text, or null."""
    if pattern is None or pattern.is_null:
        return iso_day(day(s))
    p, c = str(need_literal(pattern, "a pattern")), text0(s)

    def part(sign, n):
        at = p.find(sign)
        return F.substring(c, at + 1, n).try_cast("int") if at >= 0 else None

    year = part("YYYY", 4) if "YYYY" in p else (part("YY", 2) + 2000 if "YY" in p else None)
    if year is None:
        return const(None)
    month, d = part("MM", 2), part("DD", 2)
    digits = F.format_string("%04d-%02d-%02d", year, month if month is not None else F.lit(1), d if d is not None else F.lit(1))
    known = year.isNotNull() & (month.isNotNull() if month is not None else F.lit(True)) & (d.isNotNull() if d is not None else F.lit(True))
    return text_value(F.when(known, digits.try_cast("date").cast("string")))


verb("parseTimestamp", 2)(lambda ctx, s, *_: stamp(moment(s)))
verb("formatLocaleDate", 2)(lambda ctx, d, *_: iso_day(day(d)))
verb("coerceDate", 1)(lambda ctx, v: Value(day(v), T.DateType()))
verb("coerceTimestamp", 1)(lambda ctx, v: stamp(moment(v)))
verb("isValidDate", 2)(lambda ctx, v, *_: bool_value(moment(v).isNotNull()))


def whole(n: Value):
    return number(n).cast("int")


def _shift_days(ctx, d, n):
    moved = F.date_format(moment(d) + F.make_dt_interval(days=whole(n)), ISO)
    return text_value(F.when(is_moment(d), moved).otherwise(F.date_add(day(d), whole(n)).cast("string")))


def _shift_months(factor):
    def build(ctx, d, n):
        target = F.add_months(day(d), whole(n) * factor)
        clock = F.date_format(moment(d), "'T'HH:mm:ss'.000Z'")
        return text_value(F.when(is_moment(d), F.concat(target.cast("string"), clock)).otherwise(target.cast("string")))

    return build


verb("addDays", 2, "B")(_shift_days)
verb("addMonths", 2, "B")(_shift_months(1))
verb("addYears", 2, "B")(_shift_months(12))
for _name, _seconds in (("addHours", 3600), ("addMinutes", 60), ("addSeconds", 1)):
    verb(_name, 2, "B")(lambda ctx, t, n, k=_seconds: stamp(F.timestamp_micros(F.unix_micros(moment(t)) + (number(n) * k).cast("long") * 1000000)))


@verb("dateDiff", 3)
def date_diff(ctx, a, b, unit):
    u = str(need_literal(unit, "a unit"))
    x, y = day(a), day(b)
    months = (F.year(y) - F.year(x)) * 12 + F.month(y) - F.month(x)
    # Whole calendar units: one less if the day of the month isn't reached, on either side.
    early = F.when((months > 0) & (F.dayofmonth(y) < F.dayofmonth(x)), 1).when((months < 0) & (F.dayofmonth(y) > F.dayofmonth(x)), -1).otherwise(0)
    if u == "days":
        return long_value(F.datediff(y, x))
    if u == "months":
        return long_value(months - early)
    if u == "years":
        return long_value((months - early) / 12)
    seconds = (F.unix_micros(moment(b)) - F.unix_micros(moment(a))) / 1000000.0
    per = {"hours": 3600.0, "minutes": 60.0, "seconds": 1.0}.get(u)
    if per is None:
        ctx.errors.append(F.lit(f"T011: incompatible unit {u}"))
        return const(None)
    return Value(seconds / per, T.DoubleType())


verb("daysBetweenDates", 2, "B")(lambda ctx, a, b: long_value(F.abs(F.datediff(day(b), day(a)))))


@verb("businessDays", 2)
def business_days(ctx, d, n):
    """The date ``n`` weekdays on: whole weeks at once, then up to four steps over weekends."""
    k = whole(n)
    way = F.when(k < 0, -1).otherwise(1)
    start = F.date_add(day(d), way * (F.floor(F.abs(k) / 5) * 7).cast("int"))

    def step(x):
        nxt = F.date_add(x, way)
        dow = F.weekday(nxt)
        forward = F.when(dow == 5, F.date_add(nxt, 2)).when(dow == 6, F.date_add(nxt, 1))
        back = F.when(dow == 6, F.date_add(nxt, -2)).when(dow == 5, F.date_add(nxt, -1))
        return F.when((way > 0) & (dow >= 5), forward).when((way < 0) & (dow >= 5), back).otherwise(nxt)

    rest = (F.abs(k) % 5).cast("int")
    out = F.aggregate(F.when(rest > 0, F.sequence(F.lit(1), rest)).otherwise(F.array().cast("array<int>")), start, lambda x, _: step(x))
    return iso_day(out)


@verb("nextBusinessDay", 1)
def next_business_day(ctx, d):
    x = day(d)
    return iso_day(F.when(F.weekday(x) == 5, F.date_add(x, 2)).when(F.weekday(x) == 6, F.date_add(x, 1)).otherwise(x))


verb("startOfDay", 1, "B")(lambda ctx, d: stamp(F.date_trunc("day", moment(d))))
verb("endOfDay", 1)(lambda ctx, d: text_value(F.date_format(moment(d), "yyyy-MM-dd'T23:59:59.999Z'")))
verb("startOfMonth", 1, "B")(lambda ctx, d: iso_day(F.trunc(day(d), "month")))
verb("endOfMonth", 1)(lambda ctx, d: iso_day(F.last_day(day(d))))
verb("startOfYear", 1, "B")(lambda ctx, d: iso_day(F.trunc(day(d), "year")))
verb("endOfYear", 1)(lambda ctx, d: iso_day(F.make_date(F.year(day(d)), F.lit(12), F.lit(31))))
verb("dayOfWeek", 1)(lambda ctx, d: long_value(F.weekday(day(d)) + 1))
for _name, _f in (("dayOfMonth", F.dayofmonth), ("dayOfYear", F.dayofyear), ("weekOfYear", F.weekofyear), ("quarter", F.quarter)):
    verb(_name, 1, "B")(lambda ctx, d, f=_f: long_value(f(day(d))))


@verb("isLeapYear", 1)
def is_leap_year(ctx, d):
    y = number(d).cast("long") if isinstance(d.type, NUMBERS) else F.year(day(d)).cast("long")
    return bool_value((y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0)))


verb("isBefore", 2, "B")(lambda ctx, a, b: bool_value(text(a) < text(b)))
verb("isAfter", 2, "B")(lambda ctx, a, b: bool_value(text(a) > text(b)))
verb("isBetween", 3, "B")(lambda ctx, v, a, b: bool_value(text(v).between(text(a), text(b))))
verb("toUnix", 1, "B")(lambda ctx, t: long_value(F.unix_seconds(moment(t))))
verb("fromUnix", 1, "B")(lambda ctx, n: Value(F.timestamp_seconds(number(n).cast("long")), T.TimestampType()))


@verb("ageFromDate", 2)
def age(ctx, d, ref=None):
    x, y = day(d), day(ref) if ref is not None and not ref.is_null else F.current_date()
    before = F.date_format(y, "MMdd") < F.date_format(x, "MMdd")
    return long_value(F.year(y) - F.year(x) - before.cast("int"))


#: Parts of a duration: sign, in the time part or not, name (fixed values).
PARTS = (("Y", False, "year"), ("M", False, "month"), ("D", False, "day"), ("H", True, "hour"), ("M", True, "minute"), ("S", True, "second"))


@verb("formatDuration", 1, "U")
def format_duration(ctx, v):
    """``P1DT2H`` in words; parts of zero are left out."""
    c = text0(v)
    date_part, time_part = F.substring_index(c, "T", 1), F.regexp_extract(c, "T(.*)$", 1)
    parts = []
    for sign, timed, name in PARTS:
        n = F.regexp_extract(time_part if timed else date_part, rf"(\d+(?:\.\d+)?){sign}", 1)
        x = n.try_cast("double")
        shown = F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))
        parts.append(F.when(x > 0, F.concat(shown, F.lit(f" {name}"), F.when(x == 1, F.lit("")).otherwise(F.lit("s")))))
    words = F.concat_ws(", ", *parts)
    return text_value(F.when(F.startswith(c, F.lit("P")), F.when(words == "", F.lit("0 seconds")).otherwise(words)))
