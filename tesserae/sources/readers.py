"""Sources: JSON, CSV, XML, fixed-width, key/value, YAML, the typed notation and multi-record text as DataFrames."""

from __future__ import annotations

import csv
import io
import json
import re
import xml.parsers.expat as expat

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_DEPTH = 100


def read_json(spark: SparkSession, path: str, schema=None, *, multiline: bool = True) -> DataFrame:
    """JSON files; give a schema in production, so that no pass infers one."""
    r = spark.read.option("multiLine", multiline)
    return (r.schema(schema) if schema is not None else r).json(path)


def inferred(c: Column) -> Column:
    """A cell's own type, as a VARIANT: null, boolean, whole number, number or text."""
    s = F.btrim(c)
    plain = F.when(F.lower(s).isin("true", "false"), F.lower(s)).when(F.regexp_like(s, F.lit(r"^-?(0|[1-9]\d{0,17})$")) | F.regexp_like(s, F.lit(r"^-?(0|[1-9]\d*)\.\d+$")), s)
    quoted = F.to_json(F.array(c))
    return F.when((s == "null") | c.isNull(), F.lit(None).cast("variant")).otherwise(F.try_parse_json(F.coalesce(plain, F.substring(quoted, F.lit(2), F.length(quoted) - 2))))


def read_csv(spark: SparkSession, path: str, *, header: bool = True, delimiter: str = ",", infer_cells: bool = False) -> DataFrame:
    """CSV with doubled quotes and line breaks in cells; all texts, or VARIANT cells with ``infer_cells``."""
    df = spark.read.options(header=header, sep=delimiter, quote='"', escape='"', multiLine=True, mode="PERMISSIVE").csv(path)
    if infer_cells:
        return df.select(*[inferred(F.col(f"`{c}`")).alias(c) for c in df.columns])
    return df


def parse_csv_text(c: Column, columns: list[str], delimiter: str = ",") -> Column:
    """A line as a struct of texts; short lines are filled with empty texts. Runs as ``from_csv``."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in columns])
    row = F.from_csv(c, F.lit(schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")), {"sep": delimiter, "quote": '"', "escape": '"'})
    return F.struct(*[F.coalesce(row.getField(n), F.lit("")).alias(n) for n in columns])


def read_fixed_width(spark: SparkSession, path: str, columns: list[tuple]) -> DataFrame:
    """Lines cut by (name, position, length[, trim]), 0-based."""
    return spark.read.text(path).select(*fixed_width(F.col("value"), columns))


def fixed_width(line: Column, columns: list[tuple]) -> list[Column]:
    out = []
    for name, pos, size, *rest in columns:
        part = F.substring(line, pos + 1, size)
        out.append((F.btrim(part) if not rest or rest[0] else part).alias(name))
    return out


def key_values(text: Column) -> Column:
    """An array of (path, value) of ``key = value`` lines; ``#`` and ``;`` begin comments, ``~`` is null."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.btrim(x)), lambda x: (x != "") & ~F.substring(x, 1, 1).isin("#", ";") & F.contains(x, F.lit("=")))

    def pair(x):
        value = F.btrim(F.substring(x, F.instr(x, F.lit("=")) + 1, F.length(x)))
        bare = F.when(F.regexp_like(value, F.lit('^".*"$')), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
        return F.struct(F.btrim(F.substring_index(x, "=", 1)).alias("path"), F.when(value != "~", bare).alias("value"))

    return F.transform(lines, pair)


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    """One row per pair: file, path, value."""
    whole = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.inline(key_values(F.col("value"))))


def xml_to_object(text: str):
    """An element as objects: attributes ``@x``, mixed text ``_text``, repeats and ``item`` as arrays.

    Elements keep their prefixes, attributes lose them. ``<a/>`` and nil are null, ``<a></a>`` is an empty text; texts are trimmed.
    """
    parser = expat.ParserCreate("utf-8")
    data, root = text.encode(), []
    # Of each open element: attributes, texts, children in order by name.
    open_ = [({}, [], {})]

    def start(name, attributes):
        if len(open_) > MOST_DEPTH + 1:
            raise ValueError("XML is nested too deep")
        open_.append((attributes, [], {}))

    def end(name):
        attributes, texts, children = open_.pop()
        # The event of an element that closes itself comes after its tag.
        at = parser.CurrentByteIndex
        value = _xml_value(attributes, "".join(texts).strip(), children, not texts and data[at - 2 : at] == b"/>")
        open_[-1][2].setdefault(name, []).append(value)
        if len(open_) == 1:
            root.append((name, value))

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda s: open_[-1][1].append(s)
    parser.EntityDeclHandler = _no_entities
    parser.Parse(data, True)
    return dict(root)


def _no_entities(*_):
    raise ValueError("entity declarations are not read")


def _xml_value(attributes: dict, shown: str, children: dict, closed_itself: bool):
    if (attributes.get("xsi:nil") or attributes.get("nil")) in ("true", "1"):
        return None
    if not children and not attributes:
        return None if closed_itself else shown
    out = {f"@{k.partition(':')[2] or k}": v for k, v in attributes.items() if not k.startswith("xmlns") and k not in ("xsi:nil", "nil", "nillable")}
    if not children and not shown:
        return out or None
    if shown:
        out["_text"] = shown
    # Single children come first, in order, then repeats and items.
    out |= {k: v[0] for k, v in children.items() if len(v) == 1 and k != "item"}
    return out | {k: v for k, v in children.items() if len(v) > 1 or k == "item"}


def _by_python(name: str):
    def parse(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            if name == "xml":
                return json.dumps(xml_to_object(text), ensure_ascii=False)
            if name == "csv":
                rows = list(csv.reader(io.StringIO(text.removeprefix("﻿"))))
                return json.dumps([dict(zip(rows[0], r + [""] * (len(rows[0]) - len(r)), strict=False)) for r in rows[1:]], ensure_ascii=False) if rows else "[]"
            import yaml

            return json.dumps(yaml.safe_load(text), ensure_ascii=False, default=str)
        except Exception:  # a text of another format is no object
            return None

    return parse


def text_to_json(texts: DataFrame, format: str, *, text_col: str = "value") -> DataFrame:
    """``texts`` with a column ``json``: each whole XML, CSV or YAML text as JSON, null where it is none."""
    parse = _by_python(format)
    schema = T.StructType([*texts.schema.fields, T.StructField("json", T.StringType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([parse(t) for t in column], pa.string())], names=[*batch.schema.names, "json"])

    return texts.mapInArrow(run, schema)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema=None) -> DataFrame:
    """Large XML files by rows of a tag, with Spark's own reader."""
    r = spark.read.format("xml").options(rowTag=row_tag, attributePrefix="@", valueTag="_text")
    return (r.schema(schema) if schema is not None else r).load(path)


def route_records(lines: DataFrame, plan, *, text_col: str = "value", order: tuple = ("_line",), partition: tuple = ()) -> dict[str, DataFrame]:
    """Multi-record text: one DataFrame per segment, its lines chosen by the discriminator and mapped.

    ``_line`` rises with a line's place within its file's part; verbs of row order need a ``partition`` of the lines.

    The source's ``discriminator`` is ``:pos p :len n`` or ``:field k``; a segment's ``_type`` lists its values.
    """
    from ..plans.compiler import Transform
    from ..plans.mapping import Plan

    how = plan.source.get("discriminator") or ""
    numbers = {k: int(v) for k, v in re.findall(r":(pos|len|field)\s+#*(\d+)", how)}
    delimiter = plan.source.get("delimiter") or ","
    line = F.col(text_col)
    parts = F.split(line, re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", delimiter), -1)
    mark = F.get(parts, F.lit(numbers["field"])) if "field" in numbers else F.substring(line, numbers.get("pos", 0) + 1, numbers.get("len", 1))
    rows = lines.where(F.btrim(line) != "").withColumns({"_raw": line, "_line": F.monotonically_increasing_id(), "_mark": F.btrim(mark)})
    out = {}
    for s in plan.segments:
        if s.discriminator_value is None:
            continue
        values = [v.strip() for v in s.discriminator_value.split(",")]
        most = max([int(m) for f in s.mappings for m in re.findall(r"path='\.?(\d+)'", repr(f.expr))], default=-1)
        own = rows.where(F.col("_mark").isin(*values))
        if "field" in numbers:
            own = own.withColumns({str(i): F.get(parts, F.lit(i)) for i in range(most + 1)})
        flat = Plan(source=plan.source, constants=plan.constants, tables=plan.tables, segments=[type(s)("", mappings=s.mappings)])
        out[s.name] = Transform(flat).apply(own, keep=("_line",), order=order, partition=partition)
    return out
