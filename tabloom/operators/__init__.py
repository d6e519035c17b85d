"""The table operators. ``apply(df, name, **params)`` runs one by name."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import conditional, dates, domain, missing, naming, numeric, regex_ops, reshape, text_ops  # noqa: F401
from .registry import NAMES, OPERATORS, Context, Operator, OperatorError, get, register_op


def apply(df: DataFrame, name: str, /, ctx: Context | None = None, **params) -> DataFrame:
    op = get(name)
    if op is None:
        raise OperatorError(f"no operator {name!r}")
    return op(df, ctx, **params)


__all__ = ["NAMES", "OPERATORS", "Context", "Operator", "OperatorError", "apply", "get", "register_op"]
