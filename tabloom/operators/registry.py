"""The operators by name. An operator is a function of a DataFrame and keyword parameters."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

log = logging.getLogger("tabloom")


class OperatorError(ValueError):
    """Parameters that do not fit, or a column that is missing."""


@dataclass
class Context:
    """How an operator deals with what it cannot do: raise (strict) or leave the table as it is (lenient)."""

    mode: str = "strict"
    notes: list[str] = field(default_factory=list)

    def note(self, text: str) -> None:
        if self.mode == "strict":
            raise OperatorError(text)
        log.warning(text)
        self.notes.append(text)


@dataclass(frozen=True)
class Operator:
    name: str
    run: Callable
    #: project: narrow; rows: changes the rows; ordered: needs positions; eager: looks at the data first
    kind: str
    aliases: dict[str, str]

    def __call__(self, df: DataFrame, ctx: Context | None = None, **params) -> DataFrame:
        canonical = {}
        for k, v in params.items():
            canonical.setdefault(self.aliases.get(k, k), v)
        return self.run(df, ctx or Context(), **canonical)


OPERATORS: dict[str, Operator] = {}
#: Other names of operators.
NAMES = {"project": "select", "filter": "filter_rows", "parse_date": "parse_date_text", "dedupe": "deduplicate_rows", "sort_rows": "sort", "explode": "explode_column"}


def operator(name: str, kind: str = "project", **aliases: str):
    """Register an operator. ``aliases``: other names of its parameters."""

    def put(f):
        OPERATORS[name] = Operator(name, f, kind, aliases)
        return OPERATORS[name]

    return put


def get(name: str) -> Operator | None:
    return OPERATORS.get(NAMES.get(name, name))


def register_op(name: str, f: Callable[..., DataFrame], kind: str = "project") -> None:
    """Add an operator of one's own: ``f(df, **params)``. Plans may then use it; texts are never run as code."""
    OPERATORS[name] = Operator(name, lambda df, ctx, **p: f(df, **p), kind, {})


def listed(x) -> list:
    return [] if x is None else list(x) if isinstance(x, (list, tuple)) else [x]


def present(df: DataFrame, cols, ctx: Context, what: str) -> list[str]:
    """Those of the columns that exist; the others are noted."""
    out = []
    for c in listed(cols):
        if c in df.columns:
            out.append(c)
        else:
            ctx.note(f"{what}: no column {c!r}")
    return out
