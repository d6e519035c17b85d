"""Regular-expression operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..position import q
from .registry import Context, listed, operator, present


def typed(c: Column, kind: str | None) -> Column:
    """A text as int, float, bool or text; what does not fit is null."""
    kind = (kind or "string").lower()
    if kind in ("int", "integer"):
        n = tx.number(F.replace(c, F.lit(","), F.lit("")))
        return F.when(n == F.floor(n), n.cast("long"))
    if kind in ("float", "number", "double"):
        return tx.number(F.replace(c, F.lit(","), F.lit("")))
    if kind in ("bool", "boolean"):
        return F.when(F.lower(tx.strip(c)).isin("true", "yes", "1", "y", "t"), True).when(c.isNotNull(), False)
    return c


#: Signs that look alike in scraped tables, and what they become.
ALIKE = {"′": "'", "″": '"', "–": "-", "—": "-", "−": "-", "\ufeff": "", "\u00a0": " "}
CURLY = {"‘": "'", "’": "'", "“": '"', "”": '"'}


def normalised(c: Column, curly: bool = False) -> Column:
    c = c.cast("string")
    for old, new in {**ALIKE, **(CURLY if curly else {})}.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def widened(pattern: str) -> str:
    """Digits may have commas among them."""
    marked = pattern.replace(r"[\d]+", "\0").replace("[d]+", "\0")
    return re.sub(r"(?<!\\)((?:\\\\)*)\\d\+", "\\1\0", marked).replace("\0", r"[\d,]+")


#: Patterns tried for outputs whose names hold one of these words.
VOTE_WORDS = ("vote", "yes", "no")
VOTES = (
    r"([0-9,]+)[–—-]([0-9,]+)",
    r"(\d[\d,]*)\s*[–—-]\s*(\d[\d,]*)",
    r"([0-9,]+)",
)
#: Patterns tried first for outputs of which one has one of these names; the first two for eight outputs or more.
COORDINATE_NAMES = ("lat_deg", "lat_min", "lon_deg", "lon_min", "lat", "lon", "latitude", "longitude")
DEGREES = (
    r"(\d+)°(\d+)'(?:(\d+)\")?([NS])\s+(\d+)°(\d+)'(?:(\d+)\")?([EW])",
    r"(\d+)°(\d+)'(?:(\d+)\")?([NS])\s*/\s*(\d+)°(\d+)'(?:(\d+)\")?([EW])",
)
DECIMAL = r"(\d+\.?\d*)°([NS])\s+(\d+\.?\d*)°([EW])"
#: Patterns tried for any two outputs.
PAIRS = (
    r"([0-9,]+)[–—:\-/]\s*([0-9,]+)",
    r"(\d+)[–—:\-/]\s*(\d+)",
)


def attempts(patterns: list[str], outputs: list[str]) -> list[str]:
    """Patterns in the order in which they are tried: with commas allowed, as they are, then what the outputs' names suggest."""
    low = [o.lower() for o in outputs]
    first, out = (), [w for p in patterns if (w := widened(p)) != p] + list(patterns)
    if any(x in o for o in low for x in VOTE_WORDS):
        out += VOTES
    if any(o in COORDINATE_NAMES for o in low):
        first = DEGREES[::-1] if len(outputs) >= 8 else (DECIMAL,)
    if len(outputs) == 2:
        out += PAIRS
    return [p for p in dict.fromkeys([*first, *out]) if _fits(p, len(outputs))]


def _places(pattern: str, outputs: list[str]) -> list[int | None]:
    """The group of each output: in order if there are as many, else by name; without one the output is the source itself."""
    rx = tx.compiled(pattern)
    if rx.groups == len(outputs) and not rx.groupindex:
        return list(range(1, rx.groups + 1))
    return [rx.groupindex.get(o) for o in outputs]


def _fits(pattern: str, n: int) -> bool:
    try:
        return tx.groups(pattern) >= n
    except tx.PatternError:
        return False


@operator("extract_regex", "eager", column="col", input_col="col", regex="pattern", output_groups="out_groups", groups="out_groups", out="out_groups", outputs="out_groups", out_cols="out_groups", output_cols="out_groups")
def extract_regex(df: DataFrame, ctx: Context, col=None, pattern=None, patterns=None, out_groups=None, suffix: str = "_extracted", types=None, mode: str = "strict", curly: bool = False) -> DataFrame:
    """Groups of a pattern to columns.

    - a list of columns: group 1 of each to ``<name><suffix>`` (or to ``out_groups``);
    - ``patterns`` as dicts of ``regex``, ``out_col``, ``type``, ``default``: one output each;
    - else groups 1.. to ``out_groups``: of the one pattern (``mode="strict"``), or
      (``mode="best"``) of that one of several attempts that most rows match. One
      aggregate over the data decides that: the first that over three tenths of all its
      groups' cells match, else the one with most. Nothing matched gives the source itself
      as the first output; an output that fewer than a tenth of the rows have is filled up
      from the source. A pattern with more groups than outputs, or with named ones, gives
      outputs by name, and an output without a group is the source itself.
    """
    outs, kinds = listed(out_groups), listed(types)
    if isinstance(col, (list, tuple)):
        made = {}
        for i, c in enumerate(present(df, col, ctx, "extract_regex")):
            g = 1 if tx.groups(pattern) else 0
            made[outs[i] if i < len(outs) else c + suffix] = typed(tx.group(q(c).cast("string"), pattern, g), kinds[i] if i < len(kinds) else None)
        return df.withColumns(made) if made else df
    if not present(df, col, ctx, "extract_regex"):
        return df
    several = listed(patterns) or listed(pattern)
    if several and isinstance(several[0], dict):
        made, source = {}, q(col).cast("string")
        for p in several:
            rx = p.get("regex") or p["pattern"]
            got = typed(tx.group(source, rx, 1 if tx.groups(rx) else 0), p.get("type"))
            made[p["out_col"]] = F.coalesce(got, F.lit(p["default"])) if p.get("default") is not None else got
        return df.withColumns(made)
    if not several or not outs:
        ctx.note("extract_regex: pattern and out_groups are needed")
        return df
    source = normalised(q(col), curly) if mode == "best" else q(col).cast("string")
    if mode != "best":
        return df.withColumns({o: tx.group(source, several[0], i + 1) for i, o in enumerate(outs)})
    tried = attempts(several, outs)
    # all attempts are measured in one pass over the data
    sizes = [tx.groups(p) for p in tried]
    filled = [F.count(tx.group(source, p, i + 1)).alias(f"p{k}g{i + 1}") for k, p in enumerate(tried) for i in range(sizes[k])]
    r = df.agg(F.count(F.lit(1)).alias("n"), *filled).first()
    rates = [sum(r[f"p{k}g{i + 1}"] for i in range(m)) / (r["n"] * m) if r["n"] and m else 0.0 for k, m in enumerate(sizes)]
    best = next((k for k, x in enumerate(rates) if x > 0.3), None)
    if best is None:
        best = max(range(len(tried)), key=lambda k: rates[k], default=None)
    whole = q(col).cast("string")
    if best is None or not rates[best]:
        return df.withColumns({o: whole if i == 0 else F.lit(None).cast("string") for i, o in enumerate(outs)})
    made = {}
    for o, i in zip(outs, _places(tried[best], outs)):
        got = whole if i is None else tx.group(source, tried[best], i)
        made[o] = F.coalesce(got, whole) if i is not None and r[f"p{best}g{i}"] < 0.1 * r["n"] else got
    return df.withColumns(made)


@operator("extract_pattern", "eager", column="col", out_groups="capture_groups")
def extract_pattern(df: DataFrame, ctx: Context, col: str, pattern: str, capture_groups=None) -> DataFrame:
    return extract_regex.run(df, ctx, col=col, pattern=pattern, out_groups=capture_groups, mode="best")


@operator("parse_pattern", column="col", out_groups="output_cols")
def parse_pattern(df: DataFrame, ctx: Context, col: str, pattern: str, output_cols=None, type_map: dict | None = None) -> DataFrame:
    """Groups 1.. to columns, with types."""
    if not present(df, col, ctx, "parse_pattern"):
        return df
    return df.withColumns({o: typed(tx.group(q(col).cast("string"), pattern, i + 1), (type_map or {}).get(o)) for i, o in enumerate(listed(output_cols))})


@operator("extract_structured_data", column="col")
def extract_structured_data(df: DataFrame, ctx: Context, col: str, out_cols=None, patterns=None) -> DataFrame:
    """Group 1 of one pattern for each output; a pattern without a group gives null."""
    outs, rx = listed(out_cols), listed(patterns)
    if len(outs) != len(rx):
        ctx.note("extract_structured_data: as many patterns as outputs are needed")
        return df
    if not present(df, col, ctx, "extract_structured_data"):
        return df
    return df.withColumns({o: tx.group(q(col).cast("string"), p, 1) for o, p in zip(outs, rx)})


@operator("extract_and_flag", column="col")
def extract_and_flag(df: DataFrame, ctx: Context, col: str, pattern: str, out_extracted: str, out_flag: str) -> DataFrame:
    """Group 1, and whether the pattern matched; without a group null and false."""
    if not present(df, col, ctx, "extract_and_flag"):
        return df
    c, has = q(col).cast("string"), tx.groups(pattern) > 0
    return df.withColumns({out_extracted: tx.group(c, pattern, 1), out_flag: F.coalesce(tx.found(c, pattern), F.lit(False)) if has else F.lit(False)})
