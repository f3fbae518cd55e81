"""Paths of documents as columns: ``a.b[2].c``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def build(*segments) -> Column:
    """Segments joined by dots; empty and null ones are left out."""
    every = F.array(*[s.cast("string") if isinstance(s, Column) else F.lit(str(s)) for s in segments])
    return F.array_join(F.filter(every, lambda s: s.isNotNull() & (s != "")), ".")


def split(path: Column) -> Column:
    """Names and indices in order, as texts; an index keeps its brackets."""
    return F.regexp_extract_all(path, F.lit(r"([^.\[\]]+|\[\d+\])"), 1)


def parent(path: Column) -> Column:
    """What stands before the last dot; null without one."""
    return F.when(F.contains(path, F.lit(".")), F.regexp_replace(path, r"\.[^.]*\z", ""))


def leaf(path: Column) -> Column:
    """What stands behind the last dot; the whole path without one."""
    return F.substring_index(path, ".", -1)


def general(path: Column) -> Column:
    """The path with all its indices as ``[]``: what rules name."""
    return F.regexp_replace(path, r"\[\d+\]", "[]")
