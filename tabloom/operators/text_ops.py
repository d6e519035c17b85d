"""Text operators. Nulls stay null unless ``null_policy="text"`` makes them the text ``nan``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions import text as tx
from ..position import q
from .registry import Context, listed, operator, present


@operator("trim_whitespace", col="cols", column="cols")
def trim_whitespace(df: DataFrame, ctx: Context, cols=None, out: str | None = None) -> DataFrame:
    """Without white space at the ends, that of Unicode too. ``out`` holds for a single column."""
    own = present(df, cols, ctx, "trim_whitespace")
    return df.withColumns({(out if out and len(own) == 1 else c): tx.strip(q(c).cast("string")) for c in own}) if own else df


CASES = {"lower": F.lower, "upper": F.upper, "title": tx.title}


@operator("sanitize_text", column="col")
def sanitize_text(df: DataFrame, ctx: Context, cols=None, col: str | None = None, case: str | None = None, out: str | None = None, null_policy: str = "sql") -> DataFrame:
    """Case and single spaces (ends are not trimmed). ``cols`` in place; ``col`` to ``out`` or ``<name>_normalized``."""
    if case is not None and case not in CASES:
        ctx.note(f"sanitize_text: no case {case!r}")
        case = None
    made = {}
    for c in present(df, cols if cols is not None else col, ctx, "sanitize_text"):
        x = tx.as_text(q(c), null_policy)
        x = tx.squeezed(CASES[case](x) if case else x)
        made[c if cols is not None else out or f"{names.snake([c])[0]}_normalized"] = x
    return df.withColumns(made) if made else df


@operator("clean_text", column="col")
def clean_text(df: DataFrame, ctx: Context, col: str, operations=(), null_policy: str = "sql") -> DataFrame:
    """strip, lower, upper, one after another, in place; other names are passed over."""
    if not present(df, col, ctx, "clean_text"):
        return df
    x = tx.as_text(q(col), null_policy)
    for o in listed(operations):
        x = {"strip": tx.strip, "lower": F.lower, "upper": F.upper}.get(o, lambda y: y)(x)
    return df.withColumn(col, x)


@operator("combine_columns", separator="sep")
def combine_columns(df: DataFrame, ctx: Context, cols=None, out: str = "combined", sep: str = " ", null_policy: str = "sql") -> DataFrame:
    """Texts joined by a separator; nulls are passed over (or ``nan``). Without columns an empty text."""
    own = [c for c in listed(cols) if c in df.columns]
    return df.withColumn(out, F.concat_ws(sep, *[tx.as_text(q(c), null_policy) for c in own]) if own else F.lit(""))


@operator("replace_string", column="col", input_col="col")
def replace_string(df: DataFrame, ctx: Context, col=None, pattern: str = "", replacement: str = "", regex: bool = True, out: str | None = None, writes=None, null_policy: str = "sql") -> DataFrame:
    """All matches of a pattern (or a plain text) replaced, in place or to ``out`` or ``writes``."""
    own = present(df, col, ctx, "replace_string")
    targets = listed(out) or [w for w in listed(writes)]
    made = {}
    for i, c in enumerate(own):
        x = tx.as_text(q(c), null_policy)
        x = F.regexp_replace(x, tx.java(pattern), tx.replacement(replacement, pattern)) if regex else F.replace(x, F.lit(pattern), F.lit(replacement))
        made[targets[i] if i < len(targets) else c] = x
    return df.withColumns(made) if made else df
