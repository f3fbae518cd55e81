"""Mappings on streams: those without an order of all rows run unchanged under Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.kernel import VERBS, CompileError
from ..plans.mapping import Call, Plan

#: Verbs whose result depends on other rows.
ROW_ORDER = frozenset({"rowNumber", "sequence", "resetSequence", "accumulate", "set"})


def _verbs(expr):
    if isinstance(expr, Call):
        yield expr.verb
        for a in expr.args:
            yield from _verbs(a)


def check(plan: Plan) -> None:
    """Raise for mappings that a stream can't run: verbs of row order outside a loop over a row's own array."""
    for s in plan.segments:
        if s.each is None:
            for m in s.mappings:
                bad = [v for v in _verbs(m.expr) if v in ROW_ORDER and v in VERBS]
                if bad:
                    raise CompileError(f"{bad[0]} needs an order of all rows: not on a stream")


def transform_stream(stream: DataFrame, transform, keep: tuple = ()) -> DataFrame:
    """The mapping over a streaming DataFrame; write the result with ``writeStream``."""
    check(transform.plan)
    return transform.apply(stream, keep=keep)
