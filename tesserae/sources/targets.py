"""Sources and sinks as a mapping's plan names them: ``{$source}`` chooses the reader, ``{$target}`` and the fields' directives
(``:pos :len :leftPad :rightPad :attr``) shape the text of each output row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kernel import CompileError, Value, member, text, text0
from ..plans.compiler import Transform
from ..plans.mapping import Plan
from . import readers, writers


def read_source(spark: SparkSession, path: str, plan: Plan, *, schema=None) -> DataFrame:
    """Files in the plan's source format: json, xml (``rowTag``), csv or delimited (``delimiter``, ``header``), properties, text."""
    kind, options = plan.source_format or "json", plan.source
    if kind == "json":
        return readers.read_json(spark, path, schema)
    if kind == "xml":
        return readers.read_xml(spark, path, str(options.get("rowTag") or "row"), schema)
    if kind in ("csv", "delimited"):
        return readers.read_csv(spark, path, header=_flag(options, "header"), delimiter=str(options.get("delimiter") or ","))
    if kind in ("properties", "flat"):
        return readers.read_key_values(spark, path)
    if kind in ("text", "fixed-width"):
        return spark.read.text(path)
    raise CompileError(f"no reader for {kind}")


def _flag(options: dict, name: str, default: bool = True) -> bool:
    return str(options.get(name, default)).lstrip("?").lower() != "false"


def _whole(options: dict, name: str, default: int) -> int:
    return int(str(options.get(name, default)).lstrip("#"))


def _at(row: Value, path: str) -> Value:
    for step in path.split("."):
        row = member(row, step)
    return row


def _each(v: Value, array: bool, show) -> Column:
    """The texts of a segment's items (or of itself), as an array; none where it is null."""
    if isinstance(v.type, T.ArrayType):
        kind = v.type.elementType
        return F.coalesce(F.transform(v.col, lambda x: show(Value(x, kind))), F.array().cast("array<string>"))
    return F.array(show(v))


def _segments(plan: Plan, row: Value):
    """(segment, its value): a segment without a name is the row itself."""
    for s in plan.segments:
        yield s, row if s.name in ("", "$root") else _at(row, s.name)


def _directives(m) -> dict:
    """A field's directives, whether they stand behind its path or its whole expression."""
    return dict(getattr(m.expr, "directives", ())) | dict(m.directives)


def fixed_line(v: Value, mappings, pad: str) -> Column:
    """A line of the fields that have ``:pos`` and ``:len``; numbers stand right, longer texts are cut, later fields overwrite."""
    placed = [(_directives(m), m.target) for m in mappings]
    placed = sorted(((int(d["pos"]), int(d["len"]), d, name) for d, name in placed if "pos" in d and "len" in d), key=lambda f: f[0])
    line, at = F.lit(""), 0
    for pos, size, d, name in placed:
        field = member(v, name)
        left = "leftPad" in d or ("rightPad" not in d and isinstance(field.type, T.NumericType))
        sign = str(d.get("leftPad") or d.get("rightPad") or pad)[0]
        cell = (F.lpad if left else F.rpad)(F.left(text0(field), F.lit(size)), size, F.lit(sign))
        if pos > at:
            line, at = F.concat(line, F.lit(pad * (pos - at))), pos
        if pos < at:
            line = F.overlay(F.concat(line, F.lit(" " * max(0, pos + size - at))), cell, F.lit(pos + 1), F.lit(size))
        else:
            line = F.concat(line, cell)
        at = max(at, pos + size)
    return line


def _xml_type(v: Value, prefix: str) -> Column:
    """The type attribute of a value that is no text."""
    if isinstance(v.type, T.NumericType) and not isinstance(v.type, T.IntegralType):
        whole = (v.col == F.floor(v.col)) & (F.abs(v.col) < 1e15)
        kind = F.when(whole, "integer").otherwise("number")
    else:
        known = F.lit("integer") if isinstance(v.type, T.IntegralType) else F.lit("boolean") if isinstance(v.type, T.BooleanType) else F.lit(None).cast("string")
        kind = known
    kind = F.when(v.col.isNull(), "null").otherwise(kind)
    return F.coalesce(F.concat(F.lit(f' {prefix}:type="'), kind, F.lit('"')), F.lit(""))


def xml_segment(v: Value, segment, indent: str, prefix: str, namespace: str) -> Column:
    """An element of a segment: fields with ``:attr`` are attributes, the others typed elements in their own lines."""
    own = [(m.target, "attr" in _directives(m)) for m in segment.mappings if not m.target.startswith("_")]
    name = segment.name or "root"
    head = f"<{name}" + ("" if segment.array else f' xmlns:{prefix}="{namespace}"')
    parts = [F.lit(head)]
    for field, is_attribute in own:
        if is_attribute:
            parts.append(F.concat(F.lit(f' {field}="'), writers.xml_text(text0(member(v, field))), F.lit('"')))
    parts.append(F.lit(">\n"))
    for field, is_attribute in own:
        if not is_attribute:
            x = member(v, field)
            shown = F.regexp_replace(text0(x), r"\.0\z", "") if isinstance(x.type, (T.DoubleType, T.FloatType)) else text0(x)
            parts.append(F.concat(F.lit(f"{indent}<{field}"), _xml_type(x, prefix), F.lit(">"), writers.xml_text(shown), F.lit(f"</{field}>\n")))
    return F.concat(*parts, F.lit(f"</{name}>\n"))


def _csv(v: Value, delimiter: str, header: bool) -> Column:
    """The items of the row's first array under a header of their fields; of a row without arrays its own fields."""
    fields = v.type.fields
    array = next((f for f in fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)), None)
    items = member(v, array.name) if array else None
    names = (array.dataType.elementType if array else v.type).names
    line = lambda x: F.concat_ws(delimiter, *[writers.csv_cell(text0(member(x, n)), delimiter) for n in names])
    lines = _each(items, True, line) if array else F.array(line(v))
    top = F.array(F.lit(delimiter.join(names)))
    every = F.when(F.size(lines) > 0, F.concat(top, lines) if header else lines).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.transform(every, lambda x: F.concat(x, F.lit("\n"))), "")


def render(plan: Plan, out: DataFrame, *, keep: tuple = (), prefix: str = "t", namespace: str = "urn:types") -> DataFrame:
    """Each row of a mapping's output as the text of the plan's target format, in ``value``, after the columns of ``keep``.

    Unknown formats are JSON. XML and fixed-width text follow the plan's segments in their order.
    """
    columns = [c for c in out.columns if c not in keep and c != "_errors"]
    row = Value(F.struct(*[F.col(f"`{c}`") for c in columns]), T.StructType([out.schema[c] for c in columns]))
    kind, options = plan.target_format, plan.target
    if kind in ("fixed-width", "fwf"):
        pad, ending = str(options.get("padChar") or " ")[0], str(options.get("lineEnding") or "\n")
        lines = [_each(v, s.array, lambda x, s=s: fixed_line(x, s.mappings, pad)) for s, v in _segments(plan, row)]
        value = F.array_join(F.concat(*lines), ending)
    elif kind == "xml":
        indent = " " * _whole(options, "indent", 2)
        parts = [_each(v, s.array, lambda x, s=s: xml_segment(x, s, indent, prefix, namespace)) for s, v in _segments(plan, row)]
        value = F.array_join(F.concat(*parts), "")
        if _flag(options, "declaration"):
            value = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n'), value)
    elif kind in ("csv", "delimited"):
        value = _csv(row, str(options.get("delimiter") or ","), _flag(options, "header"))
    elif kind == "json":
        value = F.to_json(row.col, {"ignoreNullFields": str(options.get("nulls") == "omit").lower(), "pretty": str(_whole(options, "indent", 0) > 0).lower()})
    else:
        value = writers.FORMS.get(kind, writers.as_json)(out.select(*columns))
    return out.select(*keep, value.alias("value"))


def transform_files(spark: SparkSession, source: str, mapping: str, target: str, *, schema=None, order=(), partition=()) -> None:
    """Read files in the mapping's source format, map each row and write the target's text, a row's text after another's."""
    t = Transform(mapping)
    out = t.apply(read_source(spark, source, t.plan, schema=schema), order=order, partition=partition)
    render(t.plan, out).write.option("lineSep", "\n").text(target)
