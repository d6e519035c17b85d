"""A plan as a Python script over the same operators, for whoever wants to read or change it."""

from __future__ import annotations

import pprint

from ..operators import get
from .execute import SKIPPED, parameters
from .model import Plan


def script(plan: Plan, source: str = "input.csv", target: str = "final") -> str:
    """The steps as calls of ``apply``, from a CSV file to a parquet folder; steps that cannot run are comments."""
    out = [
        "from tabloom.operators import Context, apply",
        "from tabloom.plans import Plan",
        "from tabloom.plans.finalize import project, sql_ready",
        "from tabloom.session import session",
        "from tabloom.sources import read_csv",
        "",
        "spark = session()",
        "ctx = Context('lenient')",
        f"df = read_csv(spark, {source!r})",
        "original = [c for c in df.columns if not c.startswith('__')]",
    ]
    for s in plan.steps:
        if s.description:
            out.append(f"# {s.step_id}: {' '.join(s.description.split())}")
        if s.op in SKIPPED or get(s.op) is None:
            out.append(f"# {s.step_id}: {s.op} has no effect here")
            continue
        params = parameters(s, plan)
        out.append(f"df = apply(df, {get(s.op).name!r}, ctx=ctx, **{pprint.pformat(params, width=100, sort_dicts=False)})")
    out += [f"plan = Plan.of({pprint.pformat(plan.json(), width=120, sort_dicts=False)})", "df = sql_ready(project(df, plan, original))", f"df.write.mode('overwrite').parquet({target!r})", ""]
    return "\n".join(out)
