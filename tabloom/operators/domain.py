"""Operators of one domain, and the escape hatch, which runs registered functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..position import q
from .registry import Context, listed, operator, present

#: Scores of matches that were not played out, and a set.
DEFAULTED = r"(?i)DEF|W/O|RET|Walkover|Retired"
SET = r"(\d+)[-–—](\d+)(?:\(\d+\))?"


def tennis(score: Column) -> dict[str, Column]:
    """All that a tennis score tells, player's games first; a drawn set counts for the opponent."""
    s = tx.strip(score.cast("string"))
    over = s.rlike(DEFAULTED)
    mine = F.transform(F.regexp_extract_all(s, F.lit(SET), F.lit(1)), lambda x: x.cast("int"))
    theirs = F.transform(F.regexp_extract_all(s, F.lit(SET), F.lit(2)), lambda x: x.cast("int"))
    sets = F.arrays_zip(mine.alias("a"), theirs.alias("b"))
    n = F.size(sets)
    some = ~over & (n > 0)

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda acc, y: acc + y)

    won = F.size(F.filter(sets, lambda g: g["a"] > g["b"]))
    out = {
        "total_sets_played": n, "player_sets_won": won, "opponent_sets_won": n - won, "total_games_played": total(mine) + total(theirs), "player_games_won": total(mine), "opponent_games_won": total(theirs),
        "player_won_first_set": F.get(mine, F.lit(0)) > F.get(theirs, F.lit(0)), "player_won_in_straight_sets": (won > 0) & (won == n),
    }
    return {"is_default_score": F.when(s.isNotNull(), over), **{k: F.when(some, v) for k, v in out.items()}}


@operator("parse_tennis_score")
def parse_tennis_score(df: DataFrame, ctx: Context, score_col: str, outcome_col: str | None = None, writes=None, winner_value: str = "Winner") -> DataFrame:
    """The named columns of a tennis score; names that a score does not tell are null. All of them without names."""
    outs = listed(writes)
    if score_col not in df.columns or (outcome_col and outcome_col not in df.columns):
        ctx.note(f"parse_tennis_score: no column {score_col!r} or {outcome_col!r}")
        return df.withColumns({w: F.lit(None).cast("string") for w in outs if w not in df.columns}) if outs else df
    told = tennis(q(score_col))
    return df.withColumns({w: told.get(w, F.lit(None).cast("string")) for w in outs or told})


def is_prime(c: Column) -> Column:
    """Whether a whole number is prime, by trial division with the numbers 6k-1 and 6k+1 to its root."""
    n = c.cast("double").cast("long")
    root = F.floor(F.sqrt(n.cast("double"))).cast("long") + 1
    trials = F.when(root >= 5, F.sequence(F.lit(5).cast("long"), root, F.lit(6).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    divided = F.exists(trials, lambda d: ((n % d == 0) & (d < n)) | ((n % (d + 2) == 0) & (d + 2 < n)))
    return F.when(n.isNull(), None).when(n < 2, False).when(n < 4, True).when((n % 2 == 0) | (n % 3 == 0), False).otherwise(~divided)


def _birth(df, ctx, reads, writes, col=None, date_pattern=None, age_pattern=None, out_date=None, out_age=None, **_):
    """Date and age texts, group 1 of a pattern each."""
    w = listed(writes)
    made = {}
    for rx, out in ((date_pattern, out_date or (w[0] if w else None)), (age_pattern, out_age or (w[1] if len(w) > 1 else None))):
        if rx and out:
            made[out] = tx.group(q(col).cast("string"), rx, 1)
    return df.withColumns(made) if made else df


def _prime(df, ctx, reads, writes, col=None, out=None, **_):
    return df.withColumn(out or listed(writes)[0], is_prime(q(col)))


def _groups(df, ctx, reads, writes, col=None, pattern="", **_):
    """Named groups of a pattern to columns of their names; a name it lacks is null."""
    index = tx.compiled(pattern).groupindex
    return df.withColumns({w: tx.group(q(col).cast("string"), pattern, index[w]) if w in index else F.lit(None).cast("string") for w in listed(writes) or list(index)})


CUSTOM: dict[str, Callable[..., DataFrame]] = {"extract_birth_date_and_age": _birth, "is_prime_number": _prime, "extract_regex_groups": _groups}


def register_custom(name: str, f: Callable[..., DataFrame]) -> None:
    """Make ``custom`` know a function ``f(df, ctx, reads, writes, **params)``."""
    CUSTOM[name] = f


@operator("custom", out_cols="writes")
def custom(df: DataFrame, ctx: Context, name: str | None = None, reads=None, writes=None, code_hint: str | None = None, description: str | None = None, **params) -> DataFrame:
    """A registered function by name. Code in a plan is never run.

    Without one: a description that speaks of lower, normalize, clean or trim gives
    lower-case trimmed texts of what is read; else what is to be written is null.
    """
    if name in CUSTOM:
        if params.get("col") is not None and not present(df, params["col"], ctx, f"custom {name}"):
            return df
        return CUSTOM[name](df, ctx, reads, writes, **params)
    if code_hint:
        ctx.notes.append("custom: code is not run; register a function")
    ins, outs = [c for c in listed(reads) if c in df.columns], [w for w in listed(writes)]
    if any(w in (description or "").lower() for w in ("lower", "normalize", "clean", "trim")) and ins:
        return df.withColumns({w: F.lower(tx.strip(q(ins[min(i, len(ins) - 1)]).cast("string"))) for i, w in enumerate(outs)}) if outs else df
    return df.withColumns({w: F.lit(None).cast("string") for w in outs if w not in df.columns}) if outs else df
