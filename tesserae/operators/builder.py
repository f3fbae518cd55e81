"""Documents made field by field. A builder is a plan: applied to a table it makes one document of each row, in one projection."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBERS = ("integer", "number", "currency", "percent")


@dataclass
class Builder:
    """Fields in order of their first setting. A value is a constant or a column of the table that ``build`` gets."""

    fields: dict = field(default_factory=dict)

    def set(self, path: str, kind: str, value, modifiers: tuple = ()) -> Builder:
        """Set or replace a field of a type; ``modifiers`` are names such as ``required``."""
        self.fields[path] = (kind, value, tuple(modifiers))
        return self

    def set_string(self, path, value, modifiers=()):
        return self.set(path, "string", value, modifiers)

    def set_integer(self, path, value, modifiers=()):
        return self.set(path, "integer", value, modifiers)

    def set_number(self, path, value, modifiers=()):
        return self.set(path, "number", value, modifiers)

    def set_boolean(self, path, value, modifiers=()):
        return self.set(path, "boolean", value, modifiers)

    def set_null(self, path, modifiers=()):
        return self.set(path, "null", None, modifiers)

    def set_currency(self, path, value, code: str | None = None, places: int = 2, modifiers=()):
        """An amount with ``places`` decimals and perhaps a currency's code."""
        amount = (value if isinstance(value, Column) else F.lit(str(value))).cast(f"decimal(38,{places})").cast("string")
        return self.set(path, "currency", F.concat(amount, F.lit(f":{code}")) if code else amount, modifiers)

    def set_metadata(self, key, kind, value):
        return self.set(f"$.{key}", kind, value)

    def remove(self, path) -> Builder:
        self.fields.pop(path, None)
        return self

    def build(self, df: DataFrame, id_col: str) -> DataFrame:
        """Assignments (doc_id, ord, path, type, text, number, mods), a document for each row; a null value is of type null."""

        def one(i, path, kind, value, mods):
            c = value if isinstance(value, Column) else F.lit(value)
            text = c.cast("string")
            number = F.substring_index(text, ":", 1).try_cast("double") if kind in _NUMBERS else F.lit(None).cast("double")
            names = F.array(*map(F.lit, mods)) if mods else F.array().cast("array<string>")
            return F.struct(
                F.lit(i).alias("ord"), F.lit(path).alias("path"), F.when(c.isNull(), F.lit("null")).otherwise(F.lit(kind)).alias("type"), text.alias("text"), number.alias("number"), names.alias("mods"),
            )

        rows = [one(i, p, *f) for i, (p, f) in enumerate(self.fields.items())]
        return df.select(F.col(id_col).cast("string").alias("doc_id"), F.inline(F.array(*rows)))
