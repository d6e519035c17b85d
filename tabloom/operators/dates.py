"""Dates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..position import POS, q
from .registry import Context, listed, operator, present

#: strftime's letters in Java's patterns.
STRFTIME = {"Y": "yyyy", "y": "yy", "m": "M", "d": "d", "B": "MMMM", "b": "MMM", "h": "MMM", "H": "H", "I": "h", "M": "m", "S": "s", "p": "a", "A": "EEEE", "a": "EEE", "j": "D", "f": "SSSSSS", "Z": "z", "z": "xx", "e": "d"}
#: Formats tried where none is given, in this order; month first where both would do.
LADDER = ("yyyy-M-d", "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "yyyy/M/d", "MMMM d, yyyy", "MMM d, yyyy", "MMM. d, yyyy", "d MMMM yyyy", "d MMM yyyy", "d MMMM, yyyy", "MMMM d yyyy", "MMM d yyyy", "M/d/yyyy", "M-d-yyyy", "d.M.yyyy", "MMMM yyyy", "MMM yyyy", "yyyy")
#: The ladder for texts without a year, which is put behind them.
WITHOUT_YEAR = ("MMMM d yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy", "M/d yyyy")
#: What may follow a date: an age or how long ago.
NOISE = (r";?\s*\d+\s+years?\s+ago.*$", r"\s*\(\s*(?:age|aged)\s*\d+\s*\).*$", r"\s*\([^)]*\byears?\b[^)]*\).*$")
YEAR = r"(?<!\d)(1\d{3}|20\d{2})(?!\d)"
PARTS = {"year": F.year, "month": F.month, "month_num": F.month, "day": F.dayofmonth, "quarter": F.quarter, "hour": F.hour, "minute": F.minute}


def java_format(fmt: str) -> str:
    """A strftime format as a Java one; text that is none of it is quoted."""
    if "%" not in fmt:
        return fmt
    out, at = "", 0
    for m in re.finditer(r"%-?([A-Za-z%])", fmt):
        out += _quoted(fmt[at : m.start()]) + ("%" if m[1] == "%" else STRFTIME[m[1]])
        at = m.end()
    return out + _quoted(fmt[at:])


def _quoted(s: str) -> str:
    return re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", s)


def cleaned(c: Column) -> Column:
    x = tx.strip(c.cast("string"))
    for rx in NOISE:
        x = F.regexp_replace(x, "(?i)" + rx, "")
    # Sept is no month name to Java; ordinal endings are none of a day's
    x = F.regexp_replace(x, r"(?i)\bsept\b", "Sep")
    return tx.squeezed(F.regexp_replace(x, r"(?<=\d)(?:st|nd|rd|th)\b", ""))


#: What letters of a format may stand for; a format with others is tried on every text.
SHAPES = {"M": r"\d+", "d": r"\d+", "H": r"\d+", "h": r"\d+", "m": r"\d+", "s": r"\d+", "MMM": r"\p{L}+\.?", "MMMM": r"\p{L}+\.?", "EEE": r"\p{L}+\.?", "EEEE": r"\p{L}+\.?", "yyyy": r"[+-]?\d{4,}"}


def shape(fmt: str) -> str | None:
    """A pattern that every text of a format fits, or nothing if the format has other letters."""
    out = ""
    for m in re.finditer(r"'(?P<quoted>[^']*)'|(?P<letters>(?P<one>[A-Za-z])(?P=one)*)|(?P<other>[^A-Za-z'])", fmt):
        if m["letters"]:
            if m["letters"] not in SHAPES:
                return None
            out += SHAPES[m["letters"]]
        else:
            out += re.escape(m["quoted"] or m["other"] or "")
    return f"^{out}$"


def parsed(c: Column, formats: list[str]) -> Column:
    """The timestamp by the first format that fits. A text is only parsed by formats of its shape: a failure costs an exception."""
    tries = []
    for f in formats:
        got, rx = F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz"), shape(f)
        tries.append(F.when(c.rlike(rx), got) if rx else got)
    return F.coalesce(*tries)


def _year_in(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c.cast("string"), YEAR, 1), F.lit(""))


@operator("parse_date_text", "eager", column="col", input_col="col", out_col="out", out_date="out", output_date="out", out_iso="out")
def parse_date_text(df: DataFrame, ctx: Context, col: str, formats=None, out: str | None = None, out_parts=None, part_names: dict | None = None, default_year: int | None = None, writes=None, infer_year: bool = False, **ignored) -> DataFrame:
    """Texts as dates: the given formats, then a fixed ladder; what fits none is null.

    A text without a year takes that of another text column of its row, else the
    commonest year of its own column (``infer_year``; one look at the data); otherwise it
    is null, never the current year. ``default_year`` overrides every year. Parts: year,
    month (also month_num), day, day_of_week (its English name) and so on, to the names
    of ``part_names``, of ``writes`` that hold the part, or ``<name>_<part>``.
    """
    if not present(df, col, ctx, "parse_date_text"):
        return df
    kind = df.schema[col].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        when = q(col).cast("timestamp_ntz")
    else:
        # each is a projection of its own, for what follows takes it several times
        df = df.withColumn("__clean", cleaned(q(col)))
        c = F.col("__clean")
        when = parsed(c, [java_format(f) for f in listed(formats)] + list(LADDER))
        year = F.lit(None).cast("string")
        if infer_year:
            own = _year_in(q(col))
            mode = df.select(own.alias("y")).where("y is not null").groupBy("y").count().orderBy(F.desc("count"), "y").first()
            others = [_year_in(q(f.name)) for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in (col, POS, "__clean")]
            year = F.coalesce(*others, F.lit(mode.y if mode else None).cast("string"))
        if default_year is not None:
            year = F.lit(str(default_year))
        if infer_year or default_year is not None:
            when = F.coalesce(when, parsed(F.concat(c, F.lit(" "), year), list(WITHOUT_YEAR)))
    df = df.withColumn("__when", when)
    when = F.col("__when")
    if default_year is not None:
        when = F.make_timestamp_ntz(F.lit(int(default_year)), F.month(when), F.dayofmonth(when), F.hour(when), F.minute(when), F.second(when).cast("decimal(16,6)"))
    target = out or col
    made = {target: when}
    for part in listed(out_parts):
        name = (part_names or {}).get(part) or next((w for w in listed(writes) if w != out and part in w.lower()), None) or f"{col}_{part}"
        if part in ("day_of_week", "weekday"):
            made[name] = F.date_format(when, "EEEE")
        elif part in PARTS:
            made[name] = PARTS[part](when).cast("long")
        else:
            ctx.note(f"parse_date_text: no part {part!r}")
    return df.withColumns(made).drop("__clean", "__when")


@operator("expand_year_range", "rows", column="col")
def expand_year_range(df: DataFrame, ctx: Context, col: str, out: str = "year", explode: bool = True, patterns=None) -> DataFrame:
    """``1994/95`` or ``1994/1995`` as its two years, a row each; other values stay as they are."""
    if not present(df, col, ctx, "expand_year_range"):
        return df
    c = tx.strip(q(col).cast("string"))
    rx = r"^(\d{4})/(\d{2}|\d{4})$"
    a, b = F.regexp_extract(c, rx, 1), F.regexp_extract(c, rx, 2)
    both = F.array(a, F.when(F.length(b) == 4, b).otherwise(F.concat(F.substring(a, 1, 2), b)))
    years = F.when(c.rlike(rx), both).otherwise(F.array(q(col).cast("string")))
    return df.withColumn(out, F.explode_outer(years) if explode else years)
