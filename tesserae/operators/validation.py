"""Schema validation: each rule is a plan over the assignments; all errors together are one table.

Errors: (doc_id, code, path, message). Rules are data of the driver (a schema), documents stay distributed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import paths
from .lineage import cut

#: Named formats as patterns; upper-cased first where marked (fixed values).
PATTERNS = {
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$", "uri": r"^[a-zA-Z][a-zA-Z0-9+\-.]*:", "url": r"^https?://[^\s/$.?#].[^\s]*$", "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "date": r"^\d{4}-\d{2}-\d{2}$", "time": r"^[T]?\d{2}:\d{2}(:\d{2})?$", "datetime": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", "date-time": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}",
    "duration": r"^P(\d+Y)?(\d+M)?(\d+W)?(\d+D)?(T(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?$", "hostname": r"^[a-zA-Z0-9]([a-zA-Z0-9\-]*[a-zA-Z0-9])?(\.[a-zA-Z0-9]([a-zA-Z0-9\-]*[a-zA-Z0-9])?)*$",
    "phone": r"^\+?[\d\s\-().]{7,20}$", "ein": r"^\d{2}-\d{7}$", "fein": r"^\d{2}-\d{7}$", "zip": r"^\d{5}(-\d{4})?$", "routing": r"^\d{9}$", "npi": r"^\d{10}$", "naic": r"^\d{5}$", "imei": r"^\d{15}$",
    "iccid": r"^\d{19,20}$", "hex": r"^[0-9a-fA-F]+$", "ssn": r"^(?!000)(\d{9}|\d{3}-\d{2}-\d{4})$", "ipv4": r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$",
}
UPPER_PATTERNS = {
    "vin": r"^[A-HJ-NPR-Z0-9]{17}$", "iban": r"^[A-Z]{2}\d{2}[A-Z0-9]{4,30}$", "bic": r"^[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}([A-Z0-9]{3})?$", "swift": r"^[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}([A-Z0-9]{3})?$", "cusip": r"^[A-Z0-9]{9}$",
    "isin": r"^[A-Z]{2}[A-Z0-9]{9}\d$", "lei": r"^[A-Z0-9]{18}\d{2}$", "dea": r"^[A-Z]{2}\d{7}$",
}
#: Codes of currencies and of states and territories (fixed values).
CURRENCIES = (
    "AED AFN ALL AMD ANG AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BRL BSD BTN BWP BYN BZD CAD CDF CHF CLP CNY COP CRC CUP CVE CZK DJF DKK DOP DZD EGP ERN ETB EUR FJD FKP GBP GEL GHS GIP GMD GNF GTQ GYD "
    "HKD HNL HRK HTG HUF IDR ILS INR IQD IRR ISK JMD JOD JPY KES KGS KHR KMF KPW KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA MKD MMK MNT MOP MRU MUR MVR MWK MXN MYR MZN NAD NGN NIO NOK NPR NZD OMR PAB PEN PGK "
    "PHP PKR PLN PYG QAR RON RSD RUB RWF SAR SBD SCR SDG SEK SGD SHP SLE SOS SRD SSP STN SVC SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH UGX USD UYU UZS VES VND VUV WST XAF XCD XOF XPF YER ZAR ZMW ZWL"
).split()
STATES = "AK AL AR AS AZ CA CO CT DC DE FL GA GU HI IA ID IL IN KS KY LA MA MD ME MI MN MO MP MS MT NC ND NE NH NJ NM NV NY OH OK OR PA PR RI SC SD TN TX UT VA VI VT WA WI WV WY".split()


def format_ok(name: str, c: Column) -> Column:
    """Whether a text has a named format; unknown names pass."""
    if name in PATTERNS:
        fits = F.regexp_like(c, F.lit(_whole(PATTERNS[name])))
        return fits & (F.length(c) <= 253) if name == "hostname" else fits
    if name in UPPER_PATTERNS:
        own = F.regexp_replace(c, r"\s", "") if name == "iban" else c
        return F.regexp_like(F.upper(own), F.lit(_whole(UPPER_PATTERNS[name])))
    if name in ("credit-card", "creditcard"):
        digits = F.regexp_replace(c, r"[\s-]", "")
        return F.regexp_like(c, F.lit(r"^[\d\s-]{13,25}$")) & F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if name == "ipv6":
        group = r"^[0-9a-fA-F]{1,4}\z"
        parts = F.split(c, "::", -1)
        # Empty groups at the end of a side don't count.
        sides = F.flatten(F.transform(parts, lambda p: F.when(p == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(p, ":+$", ""), ":", -1))))
        fine = F.forall(sides, lambda g: F.regexp_like(g, F.lit(group)))
        return F.contains(c, F.lit(":")) & fine & ((F.size(parts) == 1) & (F.size(sides) == 8) | (F.size(parts) == 2) & (F.size(sides) <= 7))
    if name == "currency-code":
        return c.isin(*CURRENCIES)
    if name == "state-us":
        return c.isin(*STATES)
    return F.lit(True)


def formats_ok(name: Column, c: Column) -> Column:
    """Whether a text has the format that another column names; unknown names pass."""
    out = F.when(F.lit(False), F.lit(True))
    for known in FORMATS:
        out = out.when(name == known, format_ok(known, c))
    return out.otherwise(F.lit(True))


def _whole(pattern: str) -> str:
    """The pattern with its last sign, the end of the text, strict about a line break there."""
    return pattern[:-1] + r"\z" if pattern.endswith("$") else pattern


FORMATS = (*PATTERNS, *UPPER_PATTERNS, "credit-card", "creditcard", "ipv6", "currency-code", "state-us", "date-iso")


def safe_pattern(pattern: str) -> bool:
    """Whether a pattern is short and has no nested or overlapping repeats, which could take exponential time."""
    if len(pattern) > 1000:
        return False
    try:
        re.compile(pattern)
    except re.error:
        return False
    nested = re.search(r"\([^()]*[+*][^()]*\)[+*{]", pattern)
    either = re.search(r"\([^()]*\|[^()]*\)[+*]", pattern)
    return not (nested or either or re.search(r"\.\*.*\.\*.*\.\*", pattern))


@dataclass
class FieldRule:
    path: str
    type: str | None = None
    required: bool = False
    computed: bool = False
    minimum: float | str | None = None
    maximum: float | str | None = None
    pattern: str | None = None
    format: str | None = None
    enum: tuple = ()
    condition: tuple | None = None  # (field, operator, value, negated)


@dataclass
class ArrayRule:
    path: str
    minimum: int | None = None
    maximum: int | None = None
    unique: bool = False
    unique_field: str | None = None


@dataclass
class Schema:
    fields: list = field(default_factory=list)
    arrays: list = field(default_factory=list)
    invariants: list = field(default_factory=list)  # (scope, left, operator, right)
    cardinalities: list = field(default_factory=list)  # (scope, fields, least, most)
    strict: bool = False


#: Types that another type's rule admits besides itself (fixed values).
ADMITS = {"number": ("integer", "currency"), "string": ("date", "timestamp", "time", "duration")}
NUMERIC = ("number", "integer", "currency", "percent")


def _error(df: DataFrame, code: str, path, message) -> DataFrame:
    path = F.lit(path) if isinstance(path, str) else path
    message = F.lit(message) if isinstance(message, str) else message
    return df.select("doc_id", F.lit(code).alias("code"), path.alias("path"), message.alias("message"))


def validate(assignments: DataFrame, schema: Schema) -> DataFrame:
    """All errors. Value rules share one scan of the assignments; per-document rules share one aggregation.

    The rules are expressions chosen by the general path: the plan's size grows with the schema, and a value is tested by the
    rules of its own path only. References need a shuffle, which is left out where a first pass finds none.
    """
    rows = assignments.where(F.col("path").isNotNull()).withColumn("general", paths.general(F.col("path")))
    parts = [_values(rows, schema), _documents(rows, schema)]
    parts += [_unique(rows, a) for a in schema.arrays if a.unique or a.unique_field]
    parts += [_references(rows)]
    parts = [p for p in parts if p is not None]
    return reduce(DataFrame.unionByName, parts) if parts else _error(rows.where(F.lit(False)), "", "", "")


def _values(rows: DataFrame, schema: Schema) -> DataFrame | None:
    """V002 to V005 and V011: an array of errors for each value, exploded. Only the rules of a value's own path are tested."""
    by_path: dict[str, list] = {}
    known = {f.path for f in schema.fields}
    text, number, kind = F.col("text"), F.col("number"), F.col("type")
    for f in schema.fields:
        present = kind != "null"

        def say(code, test, message, path=f.path):
            by_path.setdefault(path, []).append(_told(code, test, message))

        if f.type:
            say("V002", present & ~kind.isin(f.type, *ADMITS.get(f.type, ())), f"expected {f.type}")
        for bound, less in ((f.minimum, True), (f.maximum, False)):
            if bound is None:
                continue
            beyond = (lambda c, b: c < b) if less else (lambda c, b: c > b)
            if isinstance(bound, str):
                say("V003", present & kind.isin("date", "timestamp") & beyond(text, F.lit(bound)), "out of bounds")
            else:
                size = F.when(kind.isin(*NUMERIC), number).when(kind == "string", F.length(text).cast("double"))
                say("V003", present & beyond(size, F.lit(float(bound))), "out of bounds")
        if f.pattern:
            if safe_pattern(f.pattern):
                say("V004", present & (kind == "string") & ((F.length(text) > 10_000) | ~F.regexp_like(text, F.lit(f.pattern))), "pattern mismatch")
            else:
                say("V004", present & (kind == "string"), "unsafe pattern")
        if f.format:
            # Unlike the format itself, a rule of date-iso asks for a date's form.
            fine = format_ok("date" if f.format == "date-iso" else f.format, text)
            say("V004", present & kind.isin("string", "date", "timestamp", "time") & ~fine, f"not a valid {f.format}")
        if f.enum:
            say("V005", present & ~text.isin(*map(str, f.enum)), "not one of the allowed values")
    if schema.strict:
        tops = [p for a in schema.arrays for p in (a.path,)]
        fine = F.col("general").isin(*known) if known else F.lit(False)
        for p in tops:  # an item itself; its fields are known by their own rules
            fine = fine | (F.col("general") == f"{p}[]")
        unknown = F.array(_told("V011", ~fine & ~F.startswith(F.col("general"), F.lit("$")), "unknown field"))
    else:
        unknown = None
    if not by_path and unknown is None:
        return None
    found = unknown if unknown is not None else F.array().cast("array<struct<code:string,message:string>>")
    if by_path:
        of_path = None
        for path, tests in by_path.items():
            of_path = (F if of_path is None else of_path).when(F.col("general") == path, F.array(*tests))
        found = of_path.otherwise(found)
    errors = rows.select("doc_id", "path", F.explode(F.array_compact(found)).alias("e"))
    return errors.select("doc_id", F.col("e.code").alias("code"), "path", F.col("e.message").alias("message"))


def _told(code: str, test: Column, message: str) -> Column:
    return F.when(test, F.struct(F.lit(code).alias("code"), F.lit(message).alias("message")))


def _value_of(path: str, what: str) -> Column:
    """An aggregate: the text or number at a path of the document."""
    return F.max(F.when(F.col("path") == path, F.col(what)))


def _documents(rows: DataFrame, schema: Schema) -> DataFrame | None:
    """V001, V006, V008, V009 and V010: one aggregation by document, then tests of its columns."""
    wanted: dict[str, Column] = {}

    def column(key, agg):
        name = f"c{len(wanted)}" if key not in wanted else None
        if name:
            wanted[key] = (name, agg)
        return F.col(wanted[key][0])

    tests = []
    has = lambda p: F.coalesce(column(("has", p), F.max(((F.col("path") == p) & (F.col("type") != "null")).cast("int"))), F.lit(0)) == 1
    for f in schema.fields:
        if "[]" in f.path:
            continue
        if f.condition is not None:
            name, op, value, negated = f.condition
            # A bare name is a field beside the one it conditions.
            name = name if "." in name or "." not in f.path else f"{f.path.rpartition('.')[0]}.{name}"
            text, number = column(("text", name), _value_of(name, "text")), column(("number", name), _value_of(name, "number"))
            hit = _compare(text, number, op, value)
            hit = ~hit if negated else hit
            tests.append(("V010", f.path, F.col(wanted[("text", name)][0]).isNotNull() & hit & ~has(f.path) if f.required else F.lit(False), "required by condition"))
        elif f.required and not f.computed:
            tests.append(("V001", f.path, ~has(f.path), "required"))
    for f in schema.fields:
        if f.required and "[]" in f.path and f.condition is None and not f.computed:
            array, _, leaf = f.path.partition("[]")
            inside = F.startswith(F.col("general"), F.lit(f"{array}[]"))
            items = column(("items", array), F.collect_set(F.when(inside, F.regexp_extract("path", r"\[(\d+)\]", 1))))
            filled = column(("filled", f.path), F.collect_set(F.when((F.col("general") == f.path) & (F.col("type") != "null"), F.regexp_extract("path", r"\[(\d+)\]", 1))))
            tests.append(("V001", f.path, F.size(F.array_except(items, filled)) > 0, "required in an item"))
    for a in schema.arrays:
        index = F.max(F.when(F.startswith(F.col("path"), F.lit(f"{a.path}[")), F.regexp_extract("path", r"\[(\d+)\]", 1).try_cast("int")))
        n = F.coalesce(column(("n", a.path), index), F.lit(-1)) + 1
        if a.minimum is not None:
            tests.append(("V006", a.path, n < a.minimum, "too few items"))
        if a.maximum is not None:
            tests.append(("V006", a.path, n > a.maximum, "too many items"))
    for scope, left, op, right in schema.invariants:
        lead = f"{scope}." if scope else ""
        a_text, a_number = column(("text", lead + left), _value_of(lead + left, "text")), column(("number", lead + left), _value_of(lead + left, "number"))
        if isinstance(right, str) and re.fullmatch(r"[A-Za-z_]\w*(\.\w+)*", right):
            b_text, b_number = column(("text", lead + right), _value_of(lead + right, "text")), column(("number", lead + right), _value_of(lead + right, "number"))
            both = a_text.isNotNull() & b_text.isNotNull()
            fine = F.when(a_number.isNotNull() & b_number.isNotNull(), _op(a_number, op, b_number)).otherwise(_op(a_text, op, b_text) if op in ("=", "==", "!=") else F.lit(True))
        else:
            both, fine = a_text.isNotNull(), _compare(a_text, a_number, op, right)
        tests.append(("V008", scope, both & ~fine, f"{left} {op} {right}"))
    for scope, names, least, most in schema.cardinalities:
        lead = f"{scope}." if scope else ""
        count = sum((has(lead + n).cast("int") for n in names), F.lit(0))
        if least is not None:
            tests.append(("V009", scope, count < least, "too few fields"))
        if most is not None:
            tests.append(("V009", scope, count > most, "too many fields"))
    if not tests:
        return None
    docs = rows.groupBy("doc_id").agg(*[agg.alias(name) for name, agg in wanted.values()]) if wanted else rows.select("doc_id").distinct()
    flags = [F.when(test, F.struct(F.lit(code).alias("code"), F.lit(path).alias("path"), F.lit(message).alias("message"))) for code, path, test, message in tests]
    return docs.select("doc_id", F.explode(F.array_compact(F.array(*flags))).alias("e")).select("doc_id", "e.code", "e.path", "e.message")


def _op(a: Column, op: str, b) -> Column:
    return {"=": a == b, "==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def _compare(text: Column, number: Column, op: str, value) -> Column:
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return F.coalesce(_op(number, op, float(value)), F.lit(False))
    if op in ("=", "==", "!="):
        shown = str(value).lower() if isinstance(value, bool) else str(value)
        return F.coalesce(_op(text, op, shown), F.lit(False))
    return F.lit(True)


def _unique(rows: DataFrame, a: ArrayRule) -> DataFrame:
    """V007: items whose values (or one field's) equal those of an earlier item."""
    item = rows.where(F.startswith(F.col("path"), F.lit(f"{a.path}["))).withColumn("i", F.regexp_extract("path", r"\[(\d+)\]", 1).cast("int"))
    if a.unique_field:
        item = item.where(F.col("general") == f"{a.path}[].{a.unique_field}")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("general", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x.t), "|")
    keyed = item.groupBy("doc_id", "i").agg(whole.alias("key"))
    again = keyed.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("i"))).where("k > 1")
    return _error(again, "V007", F.concat(F.lit(f"{a.path}["), F.col("i"), F.lit("]")), "not unique")


def _references(rows: DataFrame) -> DataFrame | None:
    """V013 and V012: references to no path, and chains of references that come back to themselves."""
    refs = rows.where("type = 'reference'").select("doc_id", "path", F.col("text").alias("target"))
    most = refs.groupBy("doc_id").agg(F.count_distinct("path").alias("n")).agg(F.max("n")).first()[0]
    if not most:
        return None
    targets = rows.select("doc_id", F.col("path").alias("target")).distinct()
    wild = F.contains(F.col("target"), F.lit("*"))
    lost = refs.where(~wild).join(targets, ["doc_id", "target"], "left_anti")
    # A reference with stars is met by any path of its document that fits; all else in it is literal.
    fits = F.concat(F.lit(r"\A\Q"), F.replace(F.col("target"), F.lit("*"), F.lit(r"\E.*\Q")), F.lit(r"\E\z"))
    paths_of = targets.select(F.col("doc_id").alias("own"), F.col("target").alias("there"))
    lost = lost.unionByName(refs.where(wild).withColumn("fits", fits).join(paths_of, (F.col("doc_id") == F.col("own")) & F.regexp_like(F.col("there"), F.col("fits")), "left_anti").drop("fits"))
    unresolved = _error(lost, "V013", F.col("path"), "unresolved reference")
    # A chain is followed by pointer doubling: after k rounds a pointer has jumped 2**k references, in the end more
    # than any document has.
    jump = refs
    for _ in range(most.bit_length()):
        nxt = jump.select("doc_id", F.col("path").alias("target"), F.col("target").alias("far"))
        jump = cut(jump.join(nxt, ["doc_id", "target"]).select("doc_id", "path", F.col("far").alias("target")))
    # What still points after more jumps than there are references lies on a cycle or leads into one.
    return unresolved.unionByName(_error(jump.select("doc_id", "path").distinct(), "V012", F.col("path"), "circular reference"))
