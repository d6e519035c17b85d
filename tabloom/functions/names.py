"""Names of columns: cleaning, making unique, and finding the one that is meant."""

from __future__ import annotations

import re
from collections.abc import Sequence


def unique(names: Sequence[str], suffix: str = "_{}", start: int = 1) -> list[str]:
    """Names made unique whatever the case; a generated name never meets another one."""
    taken = {n.lower() for n in names}
    seen: set[str] = set()
    out = []
    for n in names:
        if n.lower() in seen:
            k = start
            while (new := n + suffix.format(k)).lower() in taken | seen:
                k += 1
            n = new
        seen.add(n.lower())
        out.append(n)
    return out


def snake(names: Sequence[str]) -> list[str]:
    """Lower case, trimmed, white space to ``_``, and only a-z, 0-9 and ``_``."""
    return unique([re.sub(r"[^a-z0-9_]", "", re.sub(r"\s+", "_", n.strip().lower())) for n in names])


def sql_names(names: Sequence[str]) -> list[str]:
    """Names any SQL dialect takes: runs of other characters to ``_``, outer ``_`` cut, a letter first."""
    out = []
    for n in names:
        n = re.sub(r"[^a-zA-Z0-9]+", "_", n).strip("_")
        out.append("col" if not n else f"col_{n}" if n[0].isdigit() else n)
    return unique(out, start=2)


def table_name(name: str) -> str:
    n = re.sub(r"[^A-Za-z0-9_]", "_", name)
    return "t" if not n else f"t_{n}" if n[0].isdigit() else n


#: Medal columns come in pairs of a name and a time.
PAIRED = ("gold", "silver", "bronze")


def header(names: Sequence[str]) -> list[str]:
    """Repeated headers of a web table: the first repeat is ``_name`` under a medal, else ``_value``; later ones are counted."""
    times: dict[str, int] = {}
    out = []
    for n in names:
        k = times[n] = times.get(n, -1) + 1
        out.append(n if not k else n + (f"_{k}" if k > 1 else "_name" if any(p in n.lower() for p in PAIRED) else "_value"))
    return unique([n or f"column_{i + 1}" for i, n in enumerate(out)])


def _plain(name: str) -> str:
    return " ".join(name.lower().split())


def strict(name: str, columns: Sequence[str]) -> str | None:
    """The column of that name; failing that, the only spelling that differs in case."""
    if name in columns:
        return name
    return next((c for c in columns if c.lower() == name.lower()), None)


def fuzzy(name: str, columns: Sequence[str]) -> str | None:
    """As ``strict``, then alike but for white space, then a column that has the one word within."""
    found = strict(name, columns) or next((c for c in columns if _plain(c) == _plain(name)), None)
    if not found and len(name.split()) == 1:
        found = next((c for c in columns if name.lower() in c.lower()), None)
    return found


def meant(name: str, columns: Sequence[str]) -> str | None:
    """What a plan may call a raw column: another case, other white space, ``_`` for spaces, or a school's column."""
    found = strict(name, columns) or next((c for c in columns if _plain(c) == _plain(name)), None)
    if not found and name.lower() == "school":
        found = next((c for c in columns if "school" in c.lower()), None)
    return found or next((c for c in columns if c.lower().replace(" ", "_") == name.lower()), None)
