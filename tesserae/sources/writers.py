"""Sinks: rows as JSON, CSV, XML, fixed-width, key/value and the typed notation, as columns of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kernel import Value, member, text, text0


def _row(df: DataFrame) -> Value:
    return Value(F.struct(*[F.col(f"`{c}`") for c in df.columns]), df.schema)


def as_json(df: DataFrame, *, omit_nulls: bool = False, pretty: bool = False) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": str(omit_nulls).lower(), "pretty": str(pretty).lower()})


def csv_cell(c: Column, delimiter: str = ",") -> Column:
    needs = F.contains(c, F.lit(delimiter)) | F.contains(c, F.lit('"')) | F.contains(c, F.lit("\n")) | F.contains(c, F.lit("\r"))
    return F.when(needs, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def as_csv(df: DataFrame, delimiter: str = ",") -> Column:
    v = _row(df)
    return F.concat_ws(delimiter, *[csv_cell(text0(member(v, c)), delimiter) for c in df.columns])


def xml_text(c: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def xml_element(name: str, v: Value, attributes: tuple = ()) -> Column:
    """An element; fields in ``attributes`` become attributes, arrays repeat the element, null is empty."""
    if isinstance(v.type, T.ArrayType):
        return F.array_join(F.transform(v.col, lambda x: xml_element(name, Value(x, v.type.elementType), attributes)), "")
    if isinstance(v.type, T.StructType):
        own = [n for n in v.type.names if n in attributes]
        heads = [F.concat(F.lit(f' {n}="'), xml_text(text0(member(v, n))), F.lit('"')) for n in own]
        inner = [xml_element(n, member(v, n), attributes) for n in v.type.names if n not in attributes]
        body = F.concat(F.lit(f"<{name}"), *heads, F.lit(">"), *inner, F.lit(f"</{name}>"))
        return F.when(v.col.isNull(), F.lit(f"<{name}/>")).otherwise(body)
    shown = text(v)
    return F.when(shown.isNull(), F.lit(f"<{name}/>")).otherwise(F.concat(F.lit(f"<{name}>"), xml_text(shown), F.lit(f"</{name}>")))


def as_xml(df: DataFrame, name: str = "record", attributes: tuple = ()) -> Column:
    return xml_element(name, _row(df), attributes)


def as_fixed_width(df: DataFrame, columns: list[tuple]) -> Column:
    """Cells at (name, position, length[, pad]); numbers stand right, longer cells are cut."""
    v, parts, at = _row(df), [], 0
    for name, pos, size, *rest in sorted(columns, key=lambda c: c[1]):
        pad = rest[0] if rest else " "
        if pos > at:
            parts.append(F.lit(" " * (pos - at)))
        field = member(v, name)
        cell = F.left(text0(field), F.lit(size))
        parts.append(F.lpad(cell, size, pad) if isinstance(field.type, T.NumericType) else F.rpad(cell, size, pad))
        at = pos + size
    return F.concat(*parts)


def _flat(prefix: str, v: Value):
    if isinstance(v.type, T.StructType):
        for n in v.type.names:
            yield from _flat(f"{prefix}.{n}" if prefix else n, member(v, n))
    else:
        yield prefix, v


def as_key_values(df: DataFrame) -> Column:
    """Sorted ``path=value`` lines; nulls are ``~``, items of arrays are numbered."""
    parts = []
    for path, v in sorted(_flat("", _row(df)), key=lambda p: p[0]):
        if isinstance(v.type, T.ArrayType):
            parts.append(_items(path, v))
        else:
            parts.append(F.concat(F.lit(f"{path}="), F.coalesce(text(v), F.lit("~"))))
    return F.concat_ws("\n", *parts)


def _items(path: str, v: Value) -> Column:
    kind = v.type.elementType
    return F.array_join(F.transform(v.col, lambda x, i: F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]="), text0(Value(x, kind)))), "\n")


def as_notation(df: DataFrame) -> Column:
    """``path = value`` lines of the typed notation."""
    parts = []
    for path, v in _flat("", _row(df)):
        shown = text(v)
        if isinstance(v.type, T.StringType):
            for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
                shown = F.replace(shown, F.lit(old), F.lit(new))
            shown = F.concat(F.lit('"'), shown, F.lit('"'))
        elif isinstance(v.type, T.IntegralType):
            shown = F.concat(F.lit("##"), shown)
        elif isinstance(v.type, T.NumericType):
            shown = F.concat(F.lit("#"), F.regexp_replace(shown, r"\.0$", ""))
        parts.append(F.concat(F.lit(f"{path} = "), F.coalesce(shown, F.lit("~"))))
    return F.concat_ws("\n", *parts)


FORMS = {"json": as_json, "csv": as_csv, "xml": as_xml, "flat": as_key_values, "properties": as_key_values, "notation": as_notation}


def as_text(df: DataFrame, format: str) -> DataFrame:
    """``df`` as one column of text in a target format; unknown formats are JSON."""
    return df.select(FORMS.get(format, as_json)(df).alias("value"))
