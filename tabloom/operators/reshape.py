"""Several values in a cell, wide and long tables, unions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..position import POS, q
from .registry import Context, OperatorError, listed, operator, present


def _parts(c: Column, rx: str, trim: bool = True) -> Column:
    parts = F.split(c, rx, -1)
    return F.transform(parts, tx.strip) if trim else parts


@operator("split_multi_value", "rows", column="col", out="value_out", separator="separators")
def split_multi_value(df: DataFrame, ctx: Context, col: str, separators=None, value_out: str | None = None, order_out: str | None = None, count_out: str | None = None, explode: bool = True, original_col_rename: str | None = None, null_policy: str = "sql") -> DataFrame:
    """Cells split at any of the separators, trimmed, empty ones kept; a row each if ``explode``.

    ``order_out`` is the place of a value from 1 (the list of places, if not exploded);
    ``count_out`` the number of values. A null is one null row.
    """
    if not present(df, col, ctx, "split_multi_value"):
        return df
    rx = "|".join(re.escape(s) for s in listed(separators) or [","])
    df = df.withColumn("__parts", _parts(tx.as_text(q(col), null_policy), rx))
    if count_out:
        df = df.withColumn(count_out, F.coalesce(F.size("__parts"), F.lit(0)))
    if original_col_rename:
        df = df.withColumnRenamed(col, original_col_rename)
    value = value_out or col
    if not explode:
        made = {value: F.col("__parts")}
        if order_out:
            made[order_out] = F.transform("__parts", lambda x, i: i + 1)
        return df.withColumns(made).drop("__parts")
    rest = [q(c) for c in df.columns if c not in ("__parts", value, order_out)]
    out = df.select(*rest, F.posexplode_outer("__parts").alias("__at", value))
    return out.withColumn(order_out, F.col("__at") + 1).drop("__at") if order_out else out.drop("__at")


@operator("explode_entities", "rows", column="col", out_entity="out", value_out="out", sep="pattern", separators="pattern")
def explode_entities(df: DataFrame, ctx: Context, col: str, pattern=",", out: str | None = None, explode: bool = True, trim_whitespace: bool = True, null_policy: str = "sql") -> DataFrame:
    """Cells split by a regular expression (one character stands for itself), a row each."""
    if not present(df, col, ctx, "explode_entities"):
        return df
    several = listed(pattern)
    rx = "|".join(re.escape(p) for p in several) if len(several) > 1 else re.escape(several[0]) if len(several[0]) == 1 else tx.java(several[0])
    parts = _parts(tx.as_text(q(col), null_policy), rx, trim_whitespace)
    return df.withColumn(out or col, F.explode_outer(parts) if explode else parts)


@operator("explode_column", "rows", column="col")
def explode_column(df: DataFrame, ctx: Context, col: str) -> DataFrame:
    """A list as rows (an empty one as a null row); other columns stay."""
    if not present(df, col, ctx, "explode_column") or not isinstance(df.schema[col].dataType, T.ArrayType):
        return df
    return df.withColumn(col, F.explode_outer(q(col)))


@operator("pivot_wider", "eager")
def pivot_wider(df: DataFrame, ctx: Context, index=None, names_from: str = "", values_from: str = "", most: int = 1000) -> DataFrame:
    """A column for each name. Two values for one place raise; so do more names than ``most``."""
    keys = [q(c) for c in listed(index)]
    r = df.groupBy(*keys, q(names_from)).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").limit(1).collect()
    if r:
        raise OperatorError(f"pivot_wider: several values for {r[0].asDict()}")
    names = sorted(x[0] for x in df.select(q(names_from)).where(q(names_from).isNotNull()).distinct().limit(most + 1).collect())
    if len(names) > most:
        raise OperatorError(f"pivot_wider: over {most} names in {names_from!r}")
    return df.groupBy(*keys).pivot(names_from, names).agg(F.first(q(values_from)))


@operator("pivot_longer", "rows", id_vars="index", var_name="names_to", value_name="values_to", value_vars="cols")
def pivot_longer(df: DataFrame, ctx: Context, cols=None, index=None, names_to: str = "variable", values_to: str = "value") -> DataFrame:
    """A row for each listed column, with its name and value; unlisted columns other than the index go. Values become one type."""
    own, keys = present(df, cols, ctx, "pivot_longer"), [c for c in listed(index) if c in df.columns and c not in (names_to, values_to)]
    if not own:
        return df
    kinds = {df.schema[c].dataType.simpleString() for c in own}
    if len(kinds) > 1:
        one = "double" if all(isinstance(df.schema[c].dataType, T.NumericType) for c in own) else "string"
        df = df.withColumns({c: q(c).cast(one) for c in own})
    ids = [q(c) for c in keys] + [F.col(POS) for _ in [0] if POS in df.columns]
    return df.unpivot(ids, [q(c) for c in own], names_to, values_to)


@operator("union_tables", "rows")
def union_tables(df: DataFrame, ctx: Context, tables_to_union=None, column_mapping: dict | None = None, all_steps=None) -> DataFrame:
    """The columns that each of the named steps writes, under their mapped names, one below the other; missing ones are null."""
    writes = {s["step_id"]: listed(s.get("writes")) for s in listed(all_steps)}
    out = None
    for step in listed(tables_to_union):
        own = [c for c in writes.get(step, ()) if c in df.columns]
        if not own:
            ctx.note(f"union_tables: step {step!r} writes no column that is there")
            continue
        names = column_mapping or {}
        names = names.get(step, names) if isinstance(names.get(step, names), dict) else names
        part = df.select(*[q(c).alias(names.get(c, c)) for c in own])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return df if out is None else out


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Tables by name, one below the other; missing columns are null."""
    for o in others:
        first = first.unionByName(o, allowMissingColumns=True)
    return first
