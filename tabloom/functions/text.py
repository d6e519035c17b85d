"""Text functions as columns: Python's regular expressions in Java's dialect, numbers, trimming, case."""

from __future__ import annotations

import re

try:
    import re._parser as _sre
except ImportError:  # Python before 3.11
    import sre_parse as _sre

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


class PatternError(ValueError):
    """A pattern that cannot be used."""


def compiled(pattern: str) -> re.Pattern:
    try:
        return re.compile(pattern)
    except re.error as e:
        raise PatternError(f"{pattern!r}: {e}") from e


def java(pattern: str) -> str:
    """A Python pattern as a Java one, checked: groups without names, Unicode classes, the end of the text."""
    names = compiled(pattern).groupindex
    pattern = re.sub(r"\(\?P<\w+>", "(", pattern)
    pattern = re.sub(r"\(\?P=(\w+)\)", lambda m: rf"(?:\{names[m[1]]})", pattern)
    return "(?U)" + re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", pattern)


def replacement(text: str, pattern: str = "") -> str:
    """A Python replacement (``\\1``, ``\\g<1>``, ``\\g<name>``) as a Java one."""
    names = compiled(pattern).groupindex if pattern else {}
    out, at = "", 0
    for m in re.finditer(r"\\(\d{1,2})|\\g<(\w+)>|\\(.)|\$", text):
        out += text[at : m.start()]
        at = m.end()
        if m[1] or m[2]:
            n = m[1] or m[2]
            out += f"${n if n.isdigit() else names[n]}"
        elif m[3]:
            out += {"n": "\n", "t": "\t"}.get(m[3], "\\\\" if m[3] == "\\" else m[3])
        else:
            out += "\\$"
    return out + text[at:]


def _optional(pattern: str) -> set[int]:
    """The groups that may take no part in a match."""
    out: set[int] = set()

    def walk(items, inside: bool) -> None:
        for name, arg in items:
            name = str(name)
            if name == "SUBPATTERN":
                if arg[0] and inside:
                    out.add(arg[0])
                walk(arg[3], inside)
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                walk(arg[2], inside or arg[0] == 0)
            elif name == "BRANCH":
                for x in arg[1]:
                    walk(x, True)
            elif name in ("ASSERT", "ASSERT_NOT"):
                walk(arg[1], inside or name == "ASSERT_NOT")
            elif name == "ATOMIC_GROUP":
                walk(arg, inside)
            elif name == "GROUPREF_EXISTS":
                for x in arg[1:]:
                    if x:
                        walk(x, True)

    walk(_sre.parse(pattern), False)
    return out


def groups(pattern: str) -> int:
    return compiled(pattern).groups


def found(c: Column, pattern: str) -> Column:
    return c.rlike(java(pattern))


def group(c: Column, pattern: str, i: int) -> Column:
    """Group i of the first match, or null. A group that took no part is null (so is it if it is empty but optional)."""
    if i > groups(pattern):
        return F.lit(None).cast("string")
    got = F.regexp_extract(c, java(pattern), i)
    if i in _optional(pattern):
        got = F.nullif(got, F.lit(""))
    return F.when(found(c, pattern), got)


def number(c: Column) -> Column:
    """A text as a double, or null; only plain decimal notation counts."""
    t = F.trim(c.cast("string"))
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeezed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def title(c: Column) -> Column:
    """A capital after whatever is not a letter, as Python does it."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1)), F.initcap), "")


def as_text(c: Column, null_policy: str = "sql") -> Column:
    """A column as text; under the policy ``text`` a null is the text ``nan``."""
    t = c.cast("string")
    return F.coalesce(t, F.lit("nan")) if null_policy == "text" else t
