"""Documents as a long table of assignments: parse, canonical form, diff, patch and export as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import notation

ASSIGNMENT = "doc_id string, part int, ord int, path string, type string, text string, number double, mods array<string>, code string, message string, line int"


def parse_documents(texts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Assignments of each text, one row each; a text that can't be parsed gives one row with its error code."""

    def run(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in ASSIGNMENT.split(", ")]
        kinds = dict(zip(names, (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int32()), strict=True))
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    for part, doc in enumerate(notation.parse(text or "")):
                        rows += [(key, part, i, a.path, a.type, a.text, a.number, list(a.mods), None, None, None) for i, a in enumerate(doc.assignments)]
                except notation.NotationError as e:
                    rows.append((key, 0, None, None, None, None, None, None, e.code, str(e), e.line))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=names)

    return texts.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(run, ASSIGNMENT)


def assignments_of(df: DataFrame, id_col: str, *, prefix: str = "", columns: list[str] | None = None) -> DataFrame:
    """A flat table as assignments (doc_id, ord, path, type, text, number, mods): one row per column, without a shuffle."""
    names = columns or [c for c in df.columns if c != id_col]
    kinds = dict(df.dtypes)

    def one(i: int, c: str) -> Column:
        kind = {"string": "string", "boolean": "boolean", "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp"}.get(kinds[c], "integer" if kinds[c] in ("bigint", "int", "smallint", "tinyint") else "number")
        number = F.col(c).cast("double") if kind in ("integer", "number") else F.lit(None).cast("double")
        return F.struct(
            F.lit(i).alias("ord"), F.lit(prefix + c).alias("path"), F.when(F.col(c).isNull(), F.lit("null")).otherwise(F.lit(kind)).alias("type"), F.col(c).cast("string").alias("text"), number.alias("number"),
            F.array().cast("array<string>").alias("mods"),
        )

    return df.select(F.col(id_col).cast("string").alias("doc_id"), F.inline(F.array(*[one(i, c) for i, c in enumerate(names)])))


def value_text(df_columns=None) -> Column:
    """The canonical text of a value, as an expression."""
    kind, text, number = F.col("type"), F.col("text"), F.col("number")
    escaped = text
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(old), F.lit(new))
    from ..functions.kernel import double_text

    shown = double_text(number)
    short = F.when(F.contains(shown, F.lit(".")) & ~F.contains(shown, F.lit("e")), F.regexp_replace(shown, r"\.?0+$", "")).otherwise(shown)
    amount, code = F.substring_index(text, ":", 1), F.when(F.contains(text, F.lit(":")), F.upper(F.substring_index(text, ":", -1)))
    places = F.greatest(F.lit(2), F.length(F.when(F.contains(amount, F.lit(".")), F.substring_index(amount, ".", -1)).otherwise(F.lit(""))))
    fraction = F.rpad(F.when(F.contains(amount, F.lit(".")), F.substring_index(amount, ".", -1)).otherwise(F.lit("")), places, F.lit("0"))
    money = F.concat(F.lit("#$"), F.substring_index(amount, ".", 1), F.lit("."), fraction, F.coalesce(F.concat(F.lit(":"), code), F.lit("")))
    lead = F.when(kind == "integer", "##").when(kind == "percent", "#%").when(kind == "reference", "@").when(kind == "binary", "^").when(kind == "verb", "%").otherwise("")
    return F.when(kind == "null", "~").when(kind == "string", F.concat(F.lit('"'), F.coalesce(escaped, F.lit("")), F.lit('"'))).when(kind == "number", F.concat(F.lit("#"), short)).when(kind == "currency", money).otherwise(F.concat(lead, F.coalesce(text, F.lit(""))))


def shown_text() -> Column:
    """The text of a value outside the notation: references and binaries keep their signs, nulls are null."""
    kind = F.col("type")
    return F.when(kind == "reference", F.concat(F.lit("@"), F.col("text"))).when(kind == "binary", F.concat(F.lit("^"), F.col("text"))).when(kind != "null", F.col("text"))


def get(assignments: DataFrame, path: str) -> DataFrame:
    """The assignments of one path, at most one for each document."""
    return assignments.where(F.col("path") == path)


def has(assignments: DataFrame, path: str) -> DataFrame:
    """(doc_id, has): whether each document has the path."""
    return assignments.groupBy("doc_id").agg(F.max(F.coalesce(F.col("path") == path, F.lit(False))).alias("has"))


def _sort_key(path: Column) -> Column:
    """Text that sorts as the canonical order does: indices padded and before names."""
    order = F.when(F.startswith(path, F.lit("$")), "0").when(F.startswith(path, F.lit("&")), "2").otherwise("1")
    steps = F.regexp_extract_all(path, F.lit(r"([^.\[\]]+|\[\d+\])"), 1)
    keyed = F.transform(steps, lambda s: F.when(F.startswith(s, F.lit("[")), F.concat(F.lit("0"), F.lpad(F.regexp_replace(s, r"[\[\]]", ""), 12, "0"))).otherwise(F.concat(F.lit("1"), s)))
    return F.concat(order, F.lit("\x01"), F.array_join(keyed, "\x01"))


def canonical(assignments: DataFrame) -> DataFrame:
    """(doc_id, canonical, sha256): the sorted lines of each document and their digest."""
    mods = F.concat(*[F.when(F.array_contains("mods", name), F.lit(sign)).otherwise(F.lit("")) for sign, name in notation.MODIFIERS.items()])
    line = F.concat(F.col("path"), F.lit(" = "), F.coalesce(mods, F.lit("")), value_text(), F.lit("\n"))
    lines = assignments.where(F.col("path").isNotNull()).select("doc_id", F.struct(_sort_key(F.col("path")).alias("k"), line.alias("line")).alias("l"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x.line), "")
    return lines.groupBy("doc_id").agg(text.alias("canonical")).withColumn("sha256", F.sha2("canonical", 256))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes between two versions: (doc_id, op, path, from_path, old, new), op of added, removed, changed, moved.

    Both versions meet in one shuffle by document; the k-th removed and the k-th added path of equal value make a move.
    """
    side = lambda df, n: df.where(F.col("path").isNotNull()).select("doc_id", "path", F.lit(n).alias("side"), value_text().alias("value"), F.array_join(F.coalesce("mods", F.array()), ",").alias("mods"))
    rows = side(before, 0).unionByName(side(after, 1)).repartition("doc_id")
    of = lambda n, c: F.max(F.when(F.col("side") == n, F.col(c)))
    both = rows.groupBy("doc_id", "path").agg(of(0, "value").alias("old"), of(1, "value").alias("new"), of(0, "mods").alias("old_mods"), of(1, "mods").alias("new_mods"))
    both = both.where(~F.col("old").eqNullSafe(F.col("new")) | ~F.col("old_mods").eqNullSafe(F.col("new_mods")))
    op = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    both = both.select("doc_id", "path", "old", "new", op.alias("op"), F.coalesce("old", "new").alias("value"))
    order = Window.partitionBy("doc_id", "op", "value").orderBy("path")
    numbered = both.withColumn("k", F.row_number().over(order)).withColumn("own", F.when(F.col("op") == "changed", F.col("path")))
    # A changed path is a group of its own; a removed and an added one of equal value and place share a group.
    path_of = lambda name: F.max(F.when(F.col("op") == name, F.col("path")))
    pairs = numbered.groupBy("doc_id", "value", "k", "own").agg(path_of("removed").alias("gone"), path_of("added").alias("came"), F.max("old").alias("old"), F.max("new").alias("new"))
    op = F.when(F.col("own").isNotNull(), "changed").when(F.col("came").isNull(), "removed").when(F.col("gone").isNull(), "added").otherwise("moved")
    return pairs.select("doc_id", op.alias("op"), F.coalesce("own", "came", "gone").alias("path"), F.when(F.col("came").isNotNull(), F.col("gone")).alias("from_path"), "old", "new")


def patch(base: DataFrame, after: DataFrame, changes: DataFrame) -> DataFrame:
    """``base`` with ``changes`` (of ``diff(base, after)``) applied; new values come from ``after``'s rows."""
    gone = changes.select("doc_id", F.coalesce(F.when(F.col("op") == "moved", F.col("from_path")), F.col("path")).alias("path")).where(F.col("path").isNotNull()).distinct()
    kept = base.join(gone, ["doc_id", "path"], "left_anti")
    put = changes.where(F.col("op") != "removed").select("doc_id", "path", F.when(F.col("op") == "changed", 0).when(F.col("op") == "moved", 1).otherwise(2).alias("rank"))
    added = after.join(put, ["doc_id", "path"])
    both = kept.withColumn("rank", F.lit(-1)).unionByName(added)
    order = Window.partitionBy("doc_id").orderBy("rank", "ord", "path")
    return both.withColumn("ord", (F.row_number().over(order) - 1).cast("int")).drop("rank")


def export_table(assignments: DataFrame, array: str, fields: list[str]) -> DataFrame:
    """Rows of ``array[i].field`` paths: (doc_id, i, one column per field), by one grouped aggregation."""
    pattern = rf"^{array}\[(\d+)\]\.(.+)$"
    cells = assignments.where(F.col("path").rlike(pattern)).select("doc_id", F.regexp_extract("path", pattern, 1).cast("int").alias("i"), F.regexp_extract("path", pattern, 2).alias("f"), "text")
    return cells.groupBy("doc_id", "i").agg(*[F.max(F.when(F.col("f") == f, F.col("text"))).alias(f) for f in fields])


def export_flat(assignments: DataFrame) -> DataFrame:
    """(doc_id, flat): sorted ``path=value`` lines."""
    line = F.concat(F.col("path"), F.lit("="), F.coalesce("text", F.lit("~")))
    return assignments.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("flat"))
