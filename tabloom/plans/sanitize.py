"""Rewrites of a plan that need no planner: separators, years, names, and the final projection."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from ..functions import names
from ..profile import has_year
from .model import Plan, Step

#: Separators every split of a cell knows.
SEPARATORS = (",", ";", "/", " and ", " & ", "\n")
#: Roles of output columns that are kept.
KEPT_ROLES = ("canonical", "derived")


def _listed(x) -> list:
    return [x] if isinstance(x, str) else list(x) if isinstance(x, (list, tuple)) else []


def separators(plan: Plan) -> Plan:
    """All splits know the common separators, longer ones first so that none cuts another."""

    def one(s: Step) -> Step:
        if s.op != "split_multi_value":
            return s
        every = set(_listed(s.params.get("separators"))) | set(SEPARATORS)
        return replace(s, params={**s.params, "separators": sorted(every, key=lambda x: (-len(x), x))})

    return plan.with_steps([one(s) for s in plan.steps])


def years(plan: Plan, df: DataFrame) -> Plan:
    """A date column that hardly ever has a year gets no year parts and no default year. One look at the data for all of them."""
    cols = {s.params.get("col") for s in plan.steps if s.op in ("parse_date_text", "parse_date")} & set(df.columns)
    if not cols:
        return plan
    dated = has_year(df, sorted(cols))

    def one(s: Step) -> Step:
        col = s.params.get("col")
        if s.op not in ("parse_date_text", "parse_date") or dated.get(col, True):
            return s
        params = {k: v for k, v in s.params.items() if k != "default_year"}
        if isinstance(params.get("out_parts"), list):
            params["out_parts"] = [p for p in params["out_parts"] if "year" not in str(p).lower()]
        return replace(s, params=params, writes=[w for w in s.writes if "year" not in w.lower()])

    return plan.with_steps([one(s) for s in plan.steps])


def missing_reads(plan: Plan, columns: list[str]) -> Plan:
    """What a step reads but no step makes is taken for a raw column of nearly that name, which is renamed first."""
    there, wanted = set(columns), {}
    for s in plan.steps:
        for c in s.reads:
            raw = None if c in there else names.meant(c, columns)
            if raw is not None:
                wanted[raw] = c
                there.add(c)
        there |= set(s.writes)
        if s.op == "rename":
            there |= set((s.params.get("col_map") or {}).values())
    if not wanted:
        return plan
    steps = list(plan.steps)
    at = next((i for i, s in enumerate(steps) if s.op == "rename"), None)
    if at is not None:
        s = steps[at]
        col_map = {**wanted, **(s.params.get("col_map") or {})}
        steps[at] = replace(s, params={**s.params, "col_map": col_map}, writes=list(dict.fromkeys([*s.writes, *wanted.values()])))
    else:
        new = Step("s00_auto_rename", "rename", "Raw columns under the names that steps read.", list(wanted), list(wanted.values()), {"col_map": wanted})
        steps.insert(int(bool(steps) and steps[0].op == "add_row_id"), new)
    return plan.with_steps(steps)


def final_select(plan: Plan) -> Plan:
    """Selects leave snapshots of raw columns out; without a select, canonical and derived columns are selected at the end."""
    raw = {c.name for c in plan.columns if c.role == "raw_snapshot"}

    def one(s: Step) -> Step:
        kept = [c for c in _listed(s.params.get("cols")) if c not in raw]
        if s.op != "select" or kept == s.params.get("cols"):
            return s
        return replace(s, params={**s.params, "cols": kept}, writes=kept)

    steps = [one(s) for s in plan.steps]
    cols = [c.name for c in plan.columns if c.role in KEPT_ROLES]
    if not any(s.op == "select" for s in steps) and cols:
        cols.sort(key=lambda c: c != "_row_id")
        steps.append(Step("auto_final_select", "select", "Canonical and derived columns.", [], cols, {"cols": cols}))
    return plan.with_steps(steps)


def sanitize(plan: Plan, df: DataFrame) -> Plan:
    return final_select(missing_reads(years(separators(plan), df), [c for c in df.columns if not c.startswith("__")]))
