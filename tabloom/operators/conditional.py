"""Conditional columns and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from .registry import Context, listed, operator


@operator("derive_conditional", cases="conditions")
def derive_conditional(df: DataFrame, ctx: Context, out: str | None = None, conditions=None, default=None, outputs=None, operations=None, precedence: str = "standard") -> DataFrame:
    """A column by cases; of those that hold the last one counts, and without one the default.

    A case is a dict of ``if`` (or ``condition``) and ``then`` (or ``value``). Values of
    different sorts become text. A case that cannot be read is left out (lenient) or
    raises (strict). ``operations``: several such columns.
    """
    for one in listed(operations):
        df = derive_conditional.run(df, ctx, **{{"cases": "conditions"}.get(k, k): v for k, v in one.items()})
    out = out or (listed(outputs) or [None])[0]
    if out is None:
        return df
    cases = []
    for case in listed(conditions):
        test = case.get("if", case.get("condition"))
        try:
            cases.append((expr.condition(df, test, precedence), expr.value(df, case.get("then", case.get("value")))))
        except ValueError as e:
            ctx.note(f"derive_conditional: {e}")
    rest = expr.value(df, default)
    sorts = {s for _, (_, s) in cases} | {rest[1]}
    mixed = len(sorts - {"null"}) > 1

    def as_one(v):
        return v[0].cast("string") if mixed or sorts <= {"text", "null"} else v[0]

    made = None
    for test, v in reversed(cases):  # CASE takes the first that holds
        made = F.when(test, as_one(v)) if made is None else made.when(test, as_one(v))
    return df.withColumn(out, as_one(rest) if made is None else made.otherwise(as_one(rest)))


@operator("filter_rows", "rows", condition="include")
def filter_rows(df: DataFrame, ctx: Context, include: str | None = None, exclude: str | None = None, precedence: str = "standard") -> DataFrame:
    """Rows for which ``include`` (or ``condition``) holds and ``exclude`` does not; one that cannot be read does nothing (lenient)."""
    for source, keep in ((include, True), (exclude, False)):
        if source:
            try:
                test = expr.condition(df, source, precedence)
                df = df.where(test if keep else ~test)
            except ValueError as e:
                ctx.note(f"filter_rows: {e}")
    return df
