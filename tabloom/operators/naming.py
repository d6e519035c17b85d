"""Row identity, names of columns, projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..position import POS, numbered, q
from .registry import Context, listed, operator, present


@operator("add_row_id", "ordered")
def add_row_id(df: DataFrame, ctx: Context, out: str = "_row_id") -> DataFrame:
    """Numbers from 1 in row order; replaces ``out``, which comes first."""
    df = numbered(df.drop(out), out)
    return df.select(out, *[q(c) for c in df.columns if c != out])


@operator("clean_column_names")
def clean_column_names(df: DataFrame, ctx: Context) -> DataFrame:
    """Lower snake case, unique."""
    own = [c for c in df.columns if c != POS]
    new = dict(zip(own, names.snake(own)))
    return df.toDF(*[new.get(c, c) for c in df.columns])


@operator("rename", mapping="col_map")
def rename(df: DataFrame, ctx: Context, col_map: dict | None = None, mapping: dict | None = None, resolver: str = "strict") -> DataFrame:
    """New names for columns, found by the strict or the fuzzy resolver. A column that has a new name already gives way."""
    find = names.fuzzy if resolver == "fuzzy" else names.strict
    for old, new in {**(col_map or {}), **(mapping or {})}.items():
        own = find(old, df.columns)
        if own is None:
            ctx.note(f"rename: no column {old!r}")
        elif own != new:
            df = df.select(*[q(c).alias(new) if c == own else q(c) for c in df.columns if c == own or c.lower() != new.lower()])
    return df


@operator("derive_columns")
def derive_columns(df: DataFrame, ctx: Context, columns_map: dict | None = None, add_constant_col: dict | None = None) -> DataFrame:
    """Renames (missing columns are passed over) and one constant column."""
    df = df.withColumnsRenamed({k: v for k, v in (columns_map or {}).items() if k in df.columns})
    if add_constant_col:
        df = df.withColumn(add_constant_col["col_name"], F.lit(add_constant_col.get("value")))
    return df


@operator("keep_raw_snapshot")
def keep_raw_snapshot(df: DataFrame, ctx: Context, sidecar_cols=None) -> DataFrame:
    """Copies of columns: a dict (or dicts) of name and copy, or names copied to ``<name>_raw``. Only one dict overwrites."""
    over = isinstance(sidecar_cols, dict)
    pairs: list[tuple[str, str]] = []
    for x in [sidecar_cols] if over else listed(sidecar_cols):
        pairs += list(x.items()) if isinstance(x, dict) else [(x, f"{x}_raw")]
    copies = {new: q(old) for old, new in pairs if present(df, old, ctx, "keep_raw_snapshot") and (over or new not in df.columns)}
    return df.withColumns(copies) if copies else df


@operator("select", columns="cols")
def select(df: DataFrame, ctx: Context, cols=None, action: str = "keep") -> DataFrame:
    """Keep columns in the order of the list, or drop them. With none that exists the table stays."""
    own = present(df, cols, ctx, "select")
    if not own:
        return df
    if action == "drop":
        return df.drop(*own)
    return df.select(*[q(c) for c in dict.fromkeys(own)], *[POS for _ in [0] if POS in df.columns and POS not in own])


@operator("reorder_columns", cols="order")
def reorder_columns(df: DataFrame, ctx: Context, order=None) -> DataFrame:
    """The listed columns in that order; the others go."""
    return select.run(df, ctx, cols=order)


@operator("copy_and_replace", mapping="replacements")
def copy_and_replace(df: DataFrame, ctx: Context, col: str, out: str, replacements: dict | None = None) -> DataFrame:
    """A copy of a column in which whole values are replaced."""
    from .numeric import mapped

    if not present(df, col, ctx, "copy_and_replace"):
        return df
    return df.withColumn(out, mapped(df, col, replacements or {}))
