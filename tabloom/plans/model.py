"""Plans: an ordered list of operator steps and the table they are to give."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from typing import Any

ROLES = ("canonical", "derived", "helper", "raw_snapshot")


def _list(x) -> list:
    return [] if x is None else list(x) if isinstance(x, (list, tuple)) else [x]


@dataclass(frozen=True)
class Step:
    step_id: str
    op: str
    description: str = ""
    reads: list[str] = field(default_factory=list)
    writes: list[str] = field(default_factory=list)
    params: dict[str, Any] = field(default_factory=dict)
    fixes_issues: list[str] = field(default_factory=list)
    depends_on: list[str] = field(default_factory=list)

    @staticmethod
    def of(d: dict) -> Step:
        return Step(str(d.get("step_id", "")), str(d.get("op", "")), str(d.get("description") or ""), _list(d.get("reads")), _list(d.get("writes")), dict(d.get("params") or {}), _list(d.get("fixes_issues")), _list(d.get("depends_on")))


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    role: str = "derived"


@dataclass(frozen=True)
class Plan:
    table_id: str = ""
    strategy: str = ""
    steps: list[Step] = field(default_factory=list)
    primary_key: list[str] = field(default_factory=list)
    columns: list[ColumnSpec] = field(default_factory=list)

    @staticmethod
    def of(d: dict | str) -> Plan:
        """From a JSON text or the object it stands for. Columns without a name are left out."""
        if isinstance(d, str):
            d = json.loads(d)
        final = d.get("final_output") or {}
        specs = [ColumnSpec(c, "derived") if isinstance(c, str) else ColumnSpec(c["name"], c.get("role", "derived")) for c in final.get("columns") or [] if isinstance(c, str) or (isinstance(c, dict) and c.get("name"))]
        return Plan(str(d.get("table_id", "")), str(d.get("strategy", "")), [Step.of(s) for s in d.get("steps") or [] if isinstance(s, dict)], _list(final.get("primary_key")), specs)

    def json(self) -> dict:
        return {"table_id": self.table_id, "strategy": self.strategy, "steps": [asdict(s) for s in self.steps], "final_output": {"primary_key": self.primary_key, "columns": [asdict(c) for c in self.columns]}}

    def with_steps(self, steps: list[Step]) -> Plan:
        return replace(self, steps=steps)

    @property
    def last_select(self) -> Step | None:
        return next((s for s in reversed(self.steps) if s.op in ("select", "project")), None)
