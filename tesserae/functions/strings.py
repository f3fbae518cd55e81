"""Text verbs: case, trimming, slicing, padding, searching, encodings and digests."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import Value, array_value, bool_value, const, item, long_value, need_literal, number, text, text0, text_value, verb

BLANKS = " \t\n\r\x0b\x0c\x00"


def keep_type(f):
    """A verb that changes texts and passes other types through."""

    def build(ctx, v, *_):
        return text_value(f(v.col)) if isinstance(v.type, T.StringType) else v

    return build


def on_text(f):
    """A verb on the text form, null for null."""

    def build(ctx, v, *_):
        return text_value(f(text(v)))

    return build


def integer(v: Value, default: int) -> Column:
    return F.coalesce(number(v).cast("int"), F.lit(default)) if v is not None else F.lit(default)


def java_pattern(p: str) -> str | None:
    """A pattern with line anchors as defaults, or None if it is no valid pattern."""
    try:
        re.compile(p.replace(r"\A", "^").replace(r"\z", "$").replace(r"\h", "[0-9a-fA-F]"))
    except re.error:
        return None
    return "(?m)" + p.replace(r"\h", "[0-9a-fA-F]")


def quoted(s: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", s)


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("([a-zA-Z0-9]+)"), 1)


def split_case(c: Column) -> Column:
    return words(F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2"), "([A-Z]+)([A-Z][a-z])", "$1_$2"))


def first_upper(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.substring(c, 2, 1 << 30))


verb("upper", 1, "B")(keep_type(F.upper))
verb("lower", 1, "B")(keep_type(F.lower))
verb("trim", 1)(keep_type(lambda c: F.btrim(c, F.lit(BLANKS))))
verb("trimLeft", 1)(keep_type(lambda c: F.ltrim(c, F.lit(BLANKS))))
verb("trimRight", 1)(keep_type(lambda c: F.rtrim(c, F.lit(BLANKS))))
verb("capitalize", 1)(keep_type(first_upper))
verb("reverseString", 1, "B")(on_text(F.reverse))
verb("normalizeSpace", 1, also=("clean",))(on_text(lambda c: F.btrim(F.regexp_replace(c, r"\s+", " "))))
verb("titleCase", 1)(on_text(lambda c: F.array_join(F.transform(F.split(c, r"(?<=\W)(?=\w)"), first_upper), "")))
verb("camelCase", 1)(on_text(lambda c: F.array_join(F.transform(words(c), lambda w, i: F.when(i == 0, F.lower(w)).otherwise(first_upper(F.lower(w)))), "")))
verb("pascalCase", 1)(on_text(lambda c: F.array_join(F.transform(words(c), lambda w: first_upper(F.lower(w))), "")))
verb("snakeCase", 1)(on_text(lambda c: F.array_join(F.transform(split_case(c), F.lower), "_")))
verb("kebabCase", 1)(on_text(lambda c: F.array_join(F.transform(split_case(c), F.lower), "-")))
verb("slugify", 1)(on_text(lambda c: F.regexp_replace(F.btrim(F.regexp_replace(F.lower(c), r"[^a-z0-9\s-]", "")), r"[\s-]+", "-")))


@verb("stripAccents", 1, "U")
def strip_accents(ctx, v):
    @F.pandas_udf("string")
    def strip(s: pd.Series) -> pd.Series:
        gone = {c: None for c in range(0x300, 0x370)}
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFD", x).translate(gone))

    # Decomposition has no counterpart among the built-in functions. Spark can't skip the worker for plain texts; these only pass.
    return text_value(strip(text(v)))


@verb("length", 1)
def length(ctx, v):
    if isinstance(v.type, T.ArrayType):
        return long_value(F.coalesce(F.size(v.col), F.lit(0)))
    if isinstance(v.type, T.StringType):
        return long_value(F.coalesce(F.length(v.col), F.lit(0)))
    return const(0)


@verb("wordCount", 1)
def word_count(ctx, v):
    s = F.regexp_replace(F.regexp_replace(text0(v), r"^\s+|\s+$", ""), r"\s+", " ")
    return long_value(F.when(s == "", 0).otherwise(F.size(F.split(s, " "))))


@verb("soundex", 1, "U")
def soundex(ctx, v):
    """Four signs; vowels, H, W and Y all end a run of one code."""
    letters = F.regexp_replace(F.upper(text0(v)), "[^A-Z]", "")
    codes = F.translate(letters, "AEIOUYHWBFPVCGJKQSXZDTLMNR", "000000001111222222223345" + "56")
    runs = F.regexp_replace(codes, r"(.)\1+", "$1")
    tail = F.replace(F.substring(runs, 2, 1 << 30), F.lit("0"), F.lit(""))
    return text_value(F.when(letters == "", F.lit("")).otherwise(F.rpad(F.concat(F.left(letters, F.lit(1)), F.left(tail, F.lit(3))), 4, "0")))


@verb("concat", None)
def concat(ctx, *args):
    return text_value(F.concat(*[text0(a) for a in args]) if args else F.lit(""))


@verb("substring", 3)
def substring(ctx, s, start, length=None):
    """0-based; a negative start counts from the end; outside the text it is empty."""
    c, n = text0(s), F.length(text0(s))
    at = integer(start, 0)
    at = F.when(at < 0, at + n).otherwise(at)
    count = integer(length, 1 << 30) if length is not None and not length.is_null else F.lit(1 << 30)
    return text_value(F.when((at < 0) | (at > n) | (count < 0), F.lit("")).otherwise(F.substring(c, at + 1, count)))


@verb("truncate", 2)
def truncate(ctx, s, n):
    return text_value(F.left(text0(s), F.greatest(integer(n, 0), F.lit(0))))


@verb("replace", 3, "B")
def replace(ctx, s, old, new):
    return text_value(F.replace(text0(s), text0(old), text0(new)))


@verb("replaceRegex", 3)
def replace_regex(ctx, s, pattern, new):
    p = java_pattern(str(need_literal(pattern, "a pattern")))
    if p is None:
        return s
    with_ = re.sub(r"\\(\d)", r"$\1", str(need_literal(new, "a replacement")).replace("$", r"\$"))
    return text_value(F.regexp_replace(text0(s), F.lit(p), F.lit(with_)))


@verb("split", 3)
def split(ctx, s, delimiter, index=None):
    d = str(need_literal(delimiter, "a delimiter"))
    c = text0(s)
    parts = F.split(F.regexp_replace(c, r"^\s+", ""), r"\s+", -1) if d == " " else F.split(c, quoted(d), -1)
    parts = F.when(c == "", F.array().cast("array<string>")).otherwise(parts)
    if index is None or index.is_null:
        return array_value(parts, T.StringType())
    i = integer(index, 0)
    return text_value(F.get(parts, F.when(i < 0, i + F.size(parts)).otherwise(i)))


@verb("tokenize", 2)
def tokenize(ctx, s, delimiter=None):
    d = str(need_literal(delimiter, "a delimiter")) if delimiter is not None and not delimiter.is_null else " "
    parts = F.transform(F.split(text0(s), quoted(d), -1), lambda x: F.btrim(x, F.lit(BLANKS)))
    return array_value(F.filter(parts, lambda x: x != ""), T.StringType())


@verb("join", 2)
def join(ctx, arr, separator=None):
    if not isinstance(arr.type, T.ArrayType):
        return arr
    sep = str(need_literal(separator, "a separator")) if separator is not None and not separator.is_null else ","
    return text_value(F.array_join(F.transform(arr.col, lambda x: text0(item(x, arr))), sep))


verb("contains", 2, "B")(lambda ctx, a, b: bool_value(F.contains(text0(a), text0(b))))
verb("startsWith", 2, "B")(lambda ctx, a, b: bool_value(F.startswith(text0(a), text0(b))))
verb("endsWith", 2, "B")(lambda ctx, a, b: bool_value(F.endswith(text0(a), text0(b))))
verb("repeat", 2, "B")(lambda ctx, s, n: text_value(F.repeat(text0(s), F.greatest(integer(n, 0), F.lit(0)))))
verb("wrap", 3, "B")(lambda ctx, s, a, b: text_value(F.concat(text0(a), text0(s), text0(b))))
verb("levenshtein", 2, "B")(lambda ctx, a, b: long_value(F.levenshtein(text0(a), text0(b))))


@verb("match", 2, also=("matches",))
def match(ctx, s, pattern):
    p = java_pattern(str(need_literal(pattern, "a pattern")))
    return const(False) if p is None else bool_value(F.regexp_like(text0(s), F.lit(p)))


@verb("leftOf", 2)
def left_of(ctx, s, d):
    c, mark = text0(s), text0(d)
    at = F.instr(c, mark)
    return text_value(F.when(at > 0, F.left(c, at - 1)).otherwise(c))


@verb("rightOf", 2)
def right_of(ctx, s, d):
    c, mark = text0(s), text0(d)
    at = F.instr(c, mark)
    return text_value(F.when(at > 0, F.substring(c, at + F.length(mark), F.length(c))).otherwise(F.lit("")))


@verb("between", 3)
def between(ctx, s, a, b):
    c, left, right = text0(s), text0(a), text0(b)
    at = F.instr(c, left)
    rest = F.substring(c, at + F.length(left), F.length(c))
    end = F.instr(rest, right)
    return text_value(F.when((at > 0) & (end > 0), F.left(rest, end - 1)).otherwise(F.lit("")))


def _pad(left: bool, right: bool):
    def build(ctx, s, n, sign=None):
        c, width = text0(s), integer(n, 0)
        p = str(need_literal(sign, "a padding sign")) if sign is not None and not sign.is_null else " "
        p = p or " "
        missing = width - F.length(c)
        before = F.floor(missing / 2).cast("int") if right else missing
        out = c
        if left:
            out = F.lpad(out, F.length(c) + before, p)
        if right:
            out = F.rpad(out, width, p)
        return text_value(F.when(missing <= 0, c).otherwise(out))

    return build


verb("pad", 3, also=("padRight",))(_pad(False, True))
verb("padLeft", 3)(_pad(True, False))
verb("center", 3)(_pad(True, True))


@verb("mask", 2, "U")
def mask(ctx, s, pattern):
    """``#``, ``A`` and ``*`` each take a sign of the text, others stand for themselves; it ends with the text."""
    p, c = str(need_literal(pattern, "a mask")), text0(s)
    out, used = [], 0
    for sign in p:
        if sign in "#A*":
            used += 1
            out.append(F.substring(c, used, 1))
        else:
            out.append(F.when(F.length(c) > used, F.lit(sign)).otherwise(F.lit("")))
    return text_value(F.concat(*out) if out else F.lit(""))


#: By country: how many digits, the digit they begin with or "", digits left out, and the picture that the rest fills
#: (fixed values; each # takes a digit).
PHONES = {
    "US": ((10, "", 0, "(###) ###-####"), (11, "1", 1, "+1 (###) ###-####")),
    "GB": ((11, "0", 1, "+44 #### ######"), (10, "", 0, "+44 #### ######")),
    "DE": ((11, "0", 1, "+49 #### ######"), (10, "", 0, "+49 #### ######")),
    "FR": ((10, "0", 1, "+33 # ## ## ## ##"), (9, "", 0, "+33 # ## ## ## ##")),
    "AU": ((10, "0", 1, "+61 # #### ####"), (9, "", 0, "+61 # #### ####")),
    "JP": ((11, "0", 1, "+81 ##-####-####"), (10, "", 0, "+81 ##-####-####")),
}


@verb("formatPhone", 2)
def format_phone(ctx, s, country):
    land = str(need_literal(country, "a country"))
    c = text0(s)
    digits = F.regexp_replace(c, r"\D", "")
    out = c
    for n, lead, skip, picture in reversed(PHONES.get("US" if land == "CA" else land, ())):
        parts, at = [], skip + 1
        for run in re.findall("#+|[^#]+", picture):
            parts.append(F.substring(digits, at, len(run)) if run[0] == "#" else F.lit(run))
            at += len(run) if run[0] == "#" else 0
        out = F.when((F.length(digits) == n) & F.startswith(digits, F.lit(lead)), F.concat(*parts)).otherwise(out)
    return text_value(out)


def _bytes(v: Value) -> Column:
    return F.encode(text0(v), "UTF-8")


verb("base64Encode", 1, "B")(lambda ctx, v: text_value(F.replace(F.replace(F.base64(_bytes(v)), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(""))))
verb("base64Decode", 1)(lambda ctx, v: text_value(F.decode(F.try_to_binary(text0(v), F.lit("base64")), "UTF-8")))
verb("hexEncode", 1)(lambda ctx, v: text_value(F.lower(F.hex(_bytes(v)))))
verb("hexDecode", 1)(lambda ctx, v: text_value(F.decode(F.unhex(text0(v)), "UTF-8")))
verb("urlEncode", 1)(lambda ctx, v: text_value(F.replace(F.url_encode(text0(v)), F.lit("+"), F.lit("%20"))))
verb("urlDecode", 1)(lambda ctx, v: text_value(F.coalesce(F.try_url_decode(text0(v)), text0(v))))
verb("sha256", 1, "B")(lambda ctx, v: text_value(F.sha2(_bytes(v), 256)))
verb("sha512", 1, "B")(lambda ctx, v: text_value(F.sha2(_bytes(v), 512)))
verb("sha1", 1, "B")(lambda ctx, v: text_value(F.sha1(_bytes(v))))
verb("md5", 1, "B")(lambda ctx, v: text_value(F.md5(_bytes(v))))
verb("crc32", 1, "B")(lambda ctx, v: long_value(F.crc32(_bytes(v))))


@verb("jsonEncode", 1)
def json_encode(ctx, v):
    if v.is_null:
        return const("null")
    if isinstance(v.type, T.StringType):
        inner = F.to_json(F.array(v.col))
        return text_value(F.when(v.col.isNull(), F.lit("null")).otherwise(F.substring(inner, F.lit(2), F.length(inner) - 2)))
    return text_value(F.coalesce(text(v), F.lit("null")))


@verb("jsonDecode", 1)
def json_decode(ctx, v):
    """Parsed JSON as a VARIANT; null if it is none."""
    return Value(F.try_parse_json(text(v)), T.VariantType())
