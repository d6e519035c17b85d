"""Numbers, types, whole values."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr
from ..functions import text as tx
from ..position import q
from .registry import Context, listed, operator, present
from .regex_ops import typed

#: Signs that make a unit.
CURRENCIES = ("$", "€", "£", "₹")
#: Entries from which a mapping is joined rather than written into the expression.
LARGE_MAP = 200


def number_and_unit(c: Column) -> tuple[Column, Column]:
    """A text as a number and its unit: a percent sign at the end, or a currency sign before (which counts more). Commas go."""
    t = tx.strip(c.cast("string"))
    percent = t.endswith("%")
    body = F.when(percent, tx.strip(F.substring(t, F.lit(1), F.length(t) - 1))).otherwise(t)
    first = F.substring(body, 1, 1)
    money = first.isin(*CURRENCIES)
    body = F.when(money, tx.strip(F.substring(body, F.lit(2), F.length(body)))).otherwise(body)
    return tx.number(F.replace(body, F.lit(","), F.lit(""))), F.when(money, first).when(percent, F.lit("%"))


@operator("parse_number", column="col", input_col="col", output_value="out_value", output_unit="out_unit", out="out_value", regex="pattern", out_values="out_value")
def parse_number(df: DataFrame, ctx: Context, col=None, cols=None, out_value=None, out_unit: str | None = None, pattern: str | None = None, type: str | None = None, out_value_suffix: str = "_value", **ignored) -> DataFrame:
    """Texts as numbers: ``1,234``, ``12%``, ``$5``; other text is null. With a pattern, its first group.

    Several columns give ``out_value`` (a list) or ``<name><suffix>`` each, without units.
    """
    own = present(df, cols if cols is not None else col, ctx, "parse_number")
    outs, made = listed(out_value), {}
    for i, c in enumerate(own):
        if pattern:
            rx = re.sub(r"\[0-9\]\+|(?<!\\)\\d\+", r"[0-9,]+", pattern)
            n, unit = typed(tx.group(q(c).cast("string"), rx, 1 if tx.groups(rx) else 0), "float"), F.lit(None).cast("string")
        else:
            n, unit = number_and_unit(q(c))
        if type in ("int", "integer"):
            n = F.when(n == F.floor(n), n.cast("long"))
        made[outs[i] if i < len(outs) else c + out_value_suffix] = n
        if out_unit and len(own) == 1:
            made[out_unit] = unit
    return df.withColumns(made) if made else df


def _key(x) -> str:
    return "true" if x is True else "false" if x is False else str(x)


def mapped(df: DataFrame, col: str, mapping: dict) -> Column:
    """The column with whole values replaced; values the mapping lacks, or gives null, stay."""
    kind = df.schema[col].dataType
    pairs = {_key(k): v for k, v in mapping.items() if v is not None}
    if not pairs:
        return q(col)
    text = not (isinstance(kind, T.NumericType) and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in pairs.values()))
    table = F.create_map(*[F.lit(x) for k, v in pairs.items() for x in (k, _key(v) if text else float(v))])
    got = F.try_element_at(table, q(col).cast("string"))
    return F.coalesce(got, q(col).cast("string")) if text else F.coalesce(got.cast(kind), q(col))


def _replaced(df: DataFrame, col: str, out: str, mapping: dict) -> DataFrame:
    if len(mapping) < LARGE_MAP:
        return df.withColumn(out, mapped(df, col, mapping))
    rows = [(_key(k), _key(v)) for k, v in mapping.items() if v is not None]
    table = F.broadcast(df.sparkSession.createDataFrame(rows, "__k string, __v string"))
    return df.join(table, q(col).cast("string") == F.col("__k"), "left").withColumn(out, F.coalesce("__v", q(col).cast("string"))).drop("__k", "__v")


@operator("map_values", column="col")
def map_values(df: DataFrame, ctx: Context, col=None, cols=None, mapping: dict | None = None, out: str | None = None, **ignored) -> DataFrame:
    """Whole values by a mapping; others stay (``default`` has no effect). Large mappings are joined."""
    own = present(df, cols if cols is not None else col, ctx, "map_values")
    for c in own:
        df = _replaced(df, c, out if out and len(own) == 1 else c, mapping or {})
    return df


@operator("replace_value", column="col", input_col="col", columns="col", old_value="old", new_value="new")
def replace_value(df: DataFrame, ctx: Context, col=None, old=None, new=None, mapping: dict | None = None, out: str | None = None) -> DataFrame:
    """One whole value by another, or the entries of a mapping one after another (a to b, then b to c)."""
    own = present(df, col, ctx, "replace_value")
    made = {}
    for c in own:
        x, kind = q(c), df.schema[c].dataType
        for a, b in (mapping or {old: new}).items():
            text = isinstance(kind, T.StringType) or not (b is None or (isinstance(b, (int, float)) and isinstance(kind, T.NumericType)) or (isinstance(b, bool) and isinstance(kind, T.BooleanType)))
            if text and not isinstance(kind, T.StringType):
                x, kind = x.cast("string"), T.StringType()
            left = F.lit(None) if a is None else F.lit(_key(a) if text else a).try_cast(kind)
            right = F.lit(None).cast(kind) if b is None else F.lit(_key(b) if text else b).try_cast(kind)
            x = F.when(x.eqNullSafe(left), right).otherwise(x)
        made[out if out and len(own) == 1 else c] = x
    return df.withColumns(made) if made else df


@operator("cast_column", column="col", input_col="col", type="dtype")
def cast_column(df: DataFrame, ctx: Context, col=None, dtype: str = "string", out: str | None = None, python_truthiness: bool = False) -> DataFrame:
    """To integer, float, string or boolean; what does not fit is null.

    An integer column takes whole numbers only: other numbers become null (they do not
    stop the whole column). Booleans are read as true/yes/1 and false/no/0; with
    ``python_truthiness`` any text that is not empty is true.
    """
    kind = dtype.lower()
    own = present(df, col, ctx, "cast_column")
    made = {}
    for c in own:
        x, t = q(c), df.schema[c].dataType
        n = x.cast("double") if isinstance(t, (T.NumericType, T.BooleanType)) else tx.number(x)
        if kind in ("integer", "int"):
            y = F.when(n == F.floor(n), n.cast("long"))
        elif kind in ("float", "number"):
            y = n
        elif kind in ("string", "str", "text"):
            y = x.cast("string")
        elif kind in ("boolean", "bool"):
            s = F.lower(tx.strip(x.cast("string")))
            y = F.coalesce(x.cast("string") != "", F.lit(False)) if python_truthiness else F.when(s.isin("true", "yes", "y", "1", "1.0"), True).when(s.isin("false", "no", "n", "0", "0.0", ""), False)
        else:
            ctx.note(f"cast_column: no type {dtype!r}")
            return df
        made[out if out and len(own) == 1 else c] = y
    return df.withColumns(made) if made else df


@operator("derive_math", output="out", output_col="out", result="out", expression="expr")
def derive_math(df: DataFrame, ctx: Context, out: str, expr: str, reads=None) -> DataFrame:
    """An arithmetic expression over columns; what cannot be computed is null."""
    from ..functions.expr import ExpressionError, arithmetic

    try:
        return df.withColumn(out, arithmetic(df, expr))
    except ExpressionError as e:
        ctx.note(f"derive_math: {e}")
        return df.withColumn(out, F.lit(None).cast("double"))


@operator("bin_numeric", "eager", column="col")
def bin_numeric(df: DataFrame, ctx: Context, col: str, bins, labels=None, out: str | None = None) -> DataFrame:
    """Labels of ranges, closed on the right, the first on both sides; outside null. A number of bins gives equal widths."""
    if not present(df, col, ctx, "bin_numeric"):
        return df
    x = q(col).cast("double") if isinstance(df.schema[col].dataType, T.NumericType) else tx.number(q(col))
    if isinstance(bins, int):
        r = df.agg(F.min(x).alias("a"), F.max(x).alias("b")).first()
        if r.a is None:
            return df.withColumn(out or f"{col}_bin", F.lit(None).cast("string"))
        wide = (r.b - r.a) or 1.0
        edges = [r.a + wide * i / bins for i in range(bins)] + [r.b if r.b > r.a else r.a + 1.0]
    else:
        edges = [float(b) for b in bins]
    names = listed(labels) or [f"({a:g}, {b:g}]" for a, b in zip(edges, edges[1:])]
    if len(names) != len(edges) - 1:
        ctx.note("bin_numeric: one label for each bin is needed")
        return df
    y = None
    for i, name in enumerate(names):
        here = ((x >= edges[i]) if i == 0 else (x > edges[i])) & (x <= edges[i + 1])
        y = F.when(here, F.lit(str(name))) if y is None else y.when(here, F.lit(str(name)))
    return df.withColumn(out or f"{col}_bin", y)


@operator("one_hot", "eager", column="col")
def one_hot(df: DataFrame, ctx: Context, col: str, prefix: str | None = None, most: int = 1000) -> DataFrame:
    """A boolean column for each value, in order; nulls are false everywhere. More values than ``most`` are refused."""
    if not present(df, col, ctx, "one_hot"):
        return df
    values = [r[0] for r in df.select(q(col)).where(q(col).isNotNull()).distinct().limit(most + 1).collect()]
    if len(values) > most:
        ctx.note(f"one_hot: {col!r} has over {most} values")
        return df
    return df.withColumns({f"{prefix or col}_{_key(v)}": F.coalesce(q(col) == F.lit(v), F.lit(False)) for v in sorted(values)})
