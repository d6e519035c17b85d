"""Checks of plans before they run."""

from __future__ import annotations

from dataclasses import dataclass, field

from . import schema


@dataclass
class Validation:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.errors


FIELDS = {"step_id": str, "op": str, "reads": list, "writes": list, "params": dict}


def validate_plan(plan: dict, columns: list[str] | None = None) -> Validation:
    """Errors: no steps, fields that are missing or of another type, required parameters that are missing.
    Warnings: operators, reads and parameters that are not known."""
    out = Validation()
    steps = plan.get("steps") if isinstance(plan, dict) else None
    if not isinstance(plan, dict) or "steps" not in plan:
        out.errors.append("the plan has no steps")
    elif not isinstance(steps, list):
        out.errors.append("steps is not a list")
    elif not steps:
        out.errors.append("the list of steps is empty")
    if out.errors:
        return out
    there = {c.lower() for c in columns} if columns is not None else None
    for i, step in enumerate(steps):
        where = f"step {i + 1}"
        if not isinstance(step, dict):
            out.errors.append(f"{where} is not an object")
            continue
        where = f"step {step.get('step_id', i + 1)}"
        bad = [f"{where}: no {k}" for k in FIELDS if k not in step]
        bad += [f"{where}: {k} is not a {t.__name__}" for k, t in FIELDS.items() if k in step and not isinstance(step[k], t)]
        if bad:
            out.errors += bad
            continue
        op, params = step["op"], step["params"]
        if not schema.known(op):
            out.warnings.append(f"{where}: operator {op!r} is not known")
        out.errors += [f"{where}: {op} needs {p!r}" for p in schema.missing(op, params, step["writes"])]
        out.warnings += [f"{where}: {op} does not know {p!r}" for p in schema.unexpected(op, params)]
        if there is not None:
            out.warnings += [f"{where}: it reads {c!r}, which is not there" for c in step["reads"] if isinstance(c, str) and c.lower() not in there]
            there |= {w.lower() for w in step["writes"] if isinstance(w, str)}
            mapping = params.get("col_map") or params.get("mapping")
            if op == "rename" and isinstance(mapping, dict):
                there |= {str(v).lower() for v in mapping.values()}
    return out
