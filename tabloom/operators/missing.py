"""Missing values, repeated rows, order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..position import POS, filled, ordered, positioned, q
from .numeric import _key
from .registry import Context, listed, operator, present

#: Types whose values an aggregate replaces in place.
FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


@operator("fillna_static", column="col", columns="col")
def fillna_static(df: DataFrame, ctx: Context, col=None, value=None) -> DataFrame:
    """Nulls by a value; a value that is not of the column's type makes it text."""
    if value is None:
        return df
    made = {}
    for c in present(df, col, ctx, "fillna_static"):
        t = df.schema[c].dataType
        fits = isinstance(t, T.BooleanType) if isinstance(value, bool) else isinstance(t, T.NumericType) if isinstance(value, (int, float)) else isinstance(t, T.StringType)
        x, v = (q(c), F.lit(value)) if fits else (q(c).cast("string"), F.lit(_key(value)))
        if fits and isinstance(t, T.IntegralType) and isinstance(value, float) and not value.is_integer():
            x = x.cast("double")
        made[c] = F.coalesce(x, v.cast(t) if fits and not (isinstance(value, float) and not float(value).is_integer()) else v)
    return df.withColumns(made) if made else df


@operator("fillna_dynamic", "ordered", column="col", columns="col", cols="col")
def fillna_dynamic(df: DataFrame, ctx: Context, col=None, method: str = "median", source_col=None) -> DataFrame:
    """Nulls by the column's median, mean or mode (the least of the commonest), or by the value before or after."""
    own = present(df, col, ctx, "fillna_dynamic")
    if not own:
        return df
    if method in ("ffill", "bfill"):
        return filled(df, {c: q(c) for c in own}, backward=method == "bfill")
    how = {"median": F.median, "mean": F.avg, "mode": lambda x: F.mode(x, deterministic=True)}.get(method)
    if how is None:
        ctx.note(f"fillna_dynamic: no method {method!r}")
        return df
    number = {c: q(c) if isinstance(df.schema[c].dataType, T.NumericType) or method == "mode" else tx.number(q(c)) for c in own}
    one = df.agg(*[how(number[c]).alias(f"__f{i}") for i, c in enumerate(own)])
    out = df.crossJoin(F.broadcast(one))  # one row
    return out.withColumns({c: F.coalesce(number[c], F.col(f"__f{i}")) for i, c in enumerate(own)}).drop(*[f"__f{i}" for i in range(len(own))])


@operator("forward_fill", "ordered", column="col")
def forward_fill(df: DataFrame, ctx: Context, col: str) -> DataFrame:
    """Nulls and blank texts by the value before."""
    if not present(df, col, ctx, "forward_fill"):
        return df
    x = q(col)
    if isinstance(df.schema[col].dataType, T.StringType):
        x = F.when(tx.strip(x) != "", x)
    return filled(df, {col: x})


@operator("fill_down", "ordered", column="col")
def fill_down(df: DataFrame, ctx: Context, col: str) -> DataFrame:
    """Nulls by the value before."""
    return filled(df, {col: q(col)}) if present(df, col, ctx, "fill_down") else df


@operator("deduplicate_rows", "ordered", subset="keys", cols="keys")
def deduplicate_rows(df: DataFrame, ctx: Context, keys=None, keep="first") -> DataFrame:
    """One row of those with equal keys (nulls are equal): the first, the last, or none of several (``keep=False``)."""
    own = [c for c in listed(keys) if c in df.columns] or [c for c in df.columns if c != POS]
    alone = keep is False or keep == "none"
    df, had = (df, True) if alone else positioned(df)
    # the wanted position of each key is aggregated on the map side, and of a key with one row
    # the first row is that one; no key's rows meet in one task
    pick = F.first if alone else lambda x: (F.min_by if keep == "first" else F.max_by)(x, F.col(POS))
    rest = [c for c in df.columns if c not in own]
    if all(isinstance(df.schema[c].dataType, FIXED_WIDTH) for c in rest):
        # picked one by one, all from the same row: hash tables hold those, while structs are sorted
        wanted, at = [pick(q(c)).alias(f"__r{i}") for i, c in enumerate(rest)], {c: F.col(f"__r{i}") for i, c in enumerate(rest)}
    else:
        wanted, at = [pick(F.struct(*[q(c) for c in rest])).alias("__row")], {c: F.col("__row").getField(c) for c in rest}
    out = df.groupBy(*[q(c) for c in own]).agg(F.count(F.lit(1)).alias("__n"), *wanted)
    if alone:
        out = out.where("__n = 1")
    out = out.select(*[at[c].alias(c) if c in at else q(c) for c in df.columns])
    return out if had else out.drop(POS)


@operator("sort", "ordered")
def sort(df: DataFrame, ctx: Context, by=None, ascending=True, limit: int | None = None) -> DataFrame:
    """Rows in order, nulls last either way, ties by position; with a limit the first ones only. Positions are renewed."""
    own = present(df, by, ctx, "sort")
    if not own:
        return df
    up = listed(ascending) * (1 if isinstance(ascending, (list, tuple)) else len(own))
    order = [q(c).asc_nulls_last() if up[i] else q(c).desc_nulls_last() for i, c in enumerate(own)]
    if POS in df.columns:
        order.append(F.col(POS))
        if limit is None:
            return ordered(df, order)
        return df.orderBy(*order).limit(limit).drop(POS).withColumn(POS, F.monotonically_increasing_id())
    out = df.orderBy(*order)
    return out if limit is None else out.limit(limit)
