"""Whole documents as JSON, XML, CSV and fixed-width text.

Fixed-width lines are an aggregation by document. JSON, XML and CSV nest or widen as a document's paths say: the assignments
of a document are dealt to one task in order and folded there, a document at a time.
"""

from __future__ import annotations

import csv
import io
import json
import re
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .documents import shown_text

#: Types that carry their name in XML when types are kept.
TYPED = ("integer", "number", "currency", "percent", "boolean", "date", "timestamp", "time", "duration", "reference", "binary")
_CELL = re.compile(r"(.+?)\[(\d+)\]\.(.+)", re.S)


def _folded(assignments: DataFrame, name: str, fold) -> DataFrame:
    """(doc_id, name): ``fold`` of each document's rows (path, type, text, number, mods), in order."""

    def run(batches):
        import pyarrow as pa

        now, rows = None, []

        def out():
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.string()), pa.array([fold(rows)], pa.string())], names=["doc_id", name])

        for batch in batches:
            for key, _, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is not None and now != (key,):
                    yield out()
                    rows = []
                now = (key,)
                rows.append(row)
        if now is not None:
            yield out()

    rows = assignments.where(F.col("path").isNotNull()).select("doc_id", "ord", "path", "type", shown_text().alias("text"), "number", "mods")
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "ord").mapInArrow(run, f"doc_id string, {name} string")


def _json_value(kind, text, number):
    if kind == "null":
        return None
    if kind == "boolean":
        return text == "true"
    if kind == "integer":
        return int(text)
    if kind in ("number", "percent", "currency"):
        return int(number) if kind != "percent" and number == int(number) and abs(number) < 1e15 else number
    return text


def _steps(path: str) -> list:
    return [int(m[2]) if m[2] is not None else m[1] for m in re.finditer(r"([^.\[\]]+)|\[(\d+)\]", path)]


def _put(root: dict, steps: list, value) -> None:
    """Set a value below ``root``; arrays are filled with nulls up to an index."""
    here = root
    for step, after in zip(steps, [*steps[1:], None], strict=True):
        fresh = value if after is None else [] if isinstance(after, int) else {}
        if isinstance(step, int):
            here.extend([None] * (step + 1 - len(here)))
            if after is None or here[step] is None:
                here[step] = fresh
            here = here[step]
        else:
            here = here.setdefault(step, fresh) if after is not None else here.__setitem__(step, value)


def to_json(assignments: DataFrame) -> DataFrame:
    """(doc_id, json): nested objects and arrays; metadata under ``$``."""

    def fold(rows):
        root: dict = {}
        for path, kind, text, number, _ in rows:
            if not path.startswith("$."):
                _put(root, _steps(path), _json_value(kind, text, number))
        meta = {path[2:]: _json_value(kind, text, number) for path, kind, text, number, _ in rows if path.startswith("$.")}
        return json.dumps(root | ({"$": meta} if meta else {}), ensure_ascii=False)

    return _folded(assignments, "json", fold)


def to_xml(assignments: DataFrame, *, root: str = "root", types: bool = False, modifiers: bool = False, prefix: str = "t", namespace: str = "urn:types") -> DataFrame:
    """(doc_id, xml): an element for each top field or section, its fields by their last name; nulls are left out.

    ``types`` keeps the types as attributes of ``prefix`` (``modifiers`` also the modifiers).
    """
    types = types or modifiers

    def element(name, kind, text, mods, depth):
        if kind == "null":
            return ""
        amount, _, code = (text or "").partition(":") if kind == "currency" else (text or "", "", "")
        attributes = f' {prefix}:type="{kind}"' if types and kind in TYPED else ""
        attributes += f' {prefix}:currencyCode="{code}"' if types and code else ""
        attributes += "".join(f' {prefix}:{m}="true"' for m in ("required", "confidential", "deprecated") if modifiers and m in (mods or ()))
        return f"{'  ' * depth}<{_safe(name)}{attributes}>{escape(amount, {'\"': '&quot;'})}</{_safe(name)}>\n"

    def fold(rows):
        sections: dict[str, list] = {}
        for path, kind, text, _, mods in rows:
            if not path.startswith("$."):
                top, _, rest = path.partition(".")
                sections.setdefault(top, []).append((rest, kind, text, mods))
        out = ""
        for top, fields in sections.items():
            if len(fields) == 1 and not fields[0][0]:
                out += element(top, *fields[0][1:], 1)
            else:
                inner = "".join(element(rest.rpartition(".")[2] or top, kind, text, mods, 2) for rest, kind, text, mods in fields)
                out += f"  <{_safe(top)}>\n{inner}  </{_safe(top)}>\n"
        space = f' xmlns:{prefix}="{namespace}"' if types else ""
        return f'<?xml version="1.0" encoding="UTF-8"?>\n<{root}{space}>\n{out}</{root}>\n'

    return _folded(assignments, "xml", fold)


def _safe(name: str) -> str:
    """A name without signs that XML names can't have."""
    name = re.sub(r"[^A-Za-z0-9_.-]", "_", name)
    return name if re.match(r"[A-Za-z_]", name) else f"_{name}"


def to_csv(assignments: DataFrame) -> DataFrame:
    """(doc_id, csv): the rows of ``array[i].field`` paths under a header of all fields met; arrays share row numbers."""

    def fold(rows):
        cells: dict[int, dict] = {}
        columns: dict[str, None] = {}
        for path, kind, text, _, _ in rows:
            m = _CELL.fullmatch(path)
            if m:
                cells.setdefault(int(m[2]), {})[m[3]] = "" if kind == "null" else (text or "").partition(":")[0] if kind == "currency" else text
                columns[m[3]] = None
        if not cells:
            return ""
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(columns)
        writer.writerows([cells[i].get(c, "") for c in columns] for i in sorted(cells))
        return out.getvalue()

    return _folded(assignments, "csv", fold)


def to_fixed_width(assignments: DataFrame, columns: list[dict], *, width: int | None = None) -> DataFrame:
    """(doc_id, line). A column has ``path``, ``pos``, ``len`` and perhaps ``pad`` and ``align`` (left or right).

    Values are cut to their length; later columns overwrite earlier ones; the line loses its trailing spaces.
    """
    size = width or max((c["pos"] + c["len"] for c in columns), default=80)
    rows = assignments.where(F.col("path").isin(*[c["path"] for c in columns]))
    text = F.when(F.col("type") == "null", "").when(F.col("type") == "currency", F.substring_index(shown_text(), ":", 1)).otherwise(shown_text())
    of = [F.max(F.when(F.col("path") == c["path"], text)).alias(f"v{i}") for i, c in enumerate(columns)]
    values = assignments.select("doc_id").distinct().join(rows.groupBy("doc_id").agg(*of), "doc_id", "left")
    line = F.lit(" " * size)
    for i, c in enumerate(columns):
        cut = F.substring(F.coalesce(F.col(f"v{i}"), F.lit("")), 1, c["len"])
        pad = F.lpad if c.get("align") == "right" else F.rpad
        line = F.overlay(line, pad(cut, c["len"], F.lit(c.get("pad", " "))), F.lit(c["pos"] + 1), F.lit(c["len"]))
    return values.select("doc_id", F.rtrim(F.substring(line, 1, size)).alias("line"))
