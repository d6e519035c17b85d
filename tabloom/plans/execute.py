"""Plans to DataFrames.

Each step is one rewrite of a lazy DataFrame, so that Catalyst sees the whole plan: it
collapses the projections, pushes filters and columns down to the scan and plans the
shuffles. Only operators that must look at the data first run a job.
"""

from __future__ import annotations

import inspect
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr
from ..functions import text as tx
from ..operators import Context, get
from ..position import POS, q, with_position
from .finalize import project, sql_ready
from .model import Plan, Step
from .sanitize import sanitize
from .validate import validate_plan

#: Steps that have no effect in a plan: the copies they make never leave it.
SKIPPED = ("keep_raw_snapshot",)


class PlanError(ValueError):
    """A plan that cannot run in strict mode."""


@dataclass
class Report:
    steps: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def completion(self) -> float:
        """Share of steps that did what they should."""
        return sum(s["status"] in ("ok", "skipped", "replaced") for s in self.steps) / len(self.steps) if self.steps else 1.0

    def json(self) -> str:
        return json.dumps({"steps": self.steps, "warnings": self.warnings, "completion": self.completion}, indent=1)


def parameters(step: Step, plan: Plan) -> dict:
    """A step's parameters, with what its writes say about outputs that it does not name."""
    op, params = get(step.op), dict(step.params)
    takes = inspect.signature(op.run).parameters
    named = {op.aliases.get(k, k) for k in params}
    if "out" in takes and "out" not in named and len(step.writes) == 1 and step.op not in ("sort", "parse_date_text", "parse_date"):
        params["out"] = step.writes[0]
    if "writes" in takes and "writes" not in named:
        params["writes"] = step.writes
    if "reads" in takes and "reads" not in named:
        params["reads"] = step.reads
    if "all_steps" in takes:
        params["all_steps"] = [{"step_id": s.step_id, "writes": s.writes} for s in plan.steps]
    if not any(p.kind is p.VAR_KEYWORD for p in takes.values()):
        params = {k: v for k, v in params.items() if op.aliases.get(k, k) in takes}
    return params


def run_step(df: DataFrame, step: Step, plan: Plan, ctx: Context) -> DataFrame:
    op = get(step.op)
    if op is None:
        raise PlanError(f"no operator {step.op!r}")
    if op.kind != "project" and df.isStreaming and op.kind == "ordered":
        raise PlanError(f"{step.op} needs the order of rows, which a stream has not")
    return op(df, ctx, **parameters(step, plan))


def replaced(df: DataFrame, step: Step, plan: Plan, code, error: str) -> DataFrame | None:
    """The table after what a provider gives for a step that failed, if that writes all the step should, with the right types."""
    got = code.replace(asdict(step), df, error) if code is not None else None
    if got is None:
        return None
    out = df
    if callable(got):
        out = got(df)
    else:
        for one in got:
            out = run_step(out, Step.of(one), plan, Context("lenient"))
    return typed_by_name(out, step.writes) if all(w in out.columns for w in step.writes) else None


#: Parts of names that tell a column's type.
NUMBER_PARTS, WEEKDAY_PART = ("_year", "_month", "_day"), "day_of_week"
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def typed_by_name(df: DataFrame, writes: list[str]) -> DataFrame:
    """Years, months and days as numbers, and days of the week by name (of a date, or of a number from 0 for Monday)."""
    made = {}
    for w in writes:
        if w not in df.columns:
            continue
        kind = df.schema[w].dataType
        if WEEKDAY_PART in w.lower():
            if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
                made[w] = F.date_format(q(w), "EEEE")
            else:
                made[w] = F.coalesce(F.get(F.array(*map(F.lit, WEEKDAYS)), tx.number(q(w)).cast("int")), q(w).cast("string"))
        elif any(x in w.lower() for x in NUMBER_PARTS) and not isinstance(kind, T.NumericType):
            made[w] = tx.number(q(w)).cast("long")
    return df.withColumns(made) if made else df


def execute(
    df: DataFrame, plan: Plan | dict | str, mode: str = "lenient", order_by: list[str] | None = None, sanitized: bool = False, finalize: bool = True, code=None, copy_reads: bool = False, check: bool = True
) -> tuple[DataFrame, Report]:
    """The table that a plan gives, and what became of each step.

    lenient: a step that fails leaves the table as it is and is reported; strict: it raises.
    ``order_by``: columns that give the rows' order; else it is that of the scan. ``code``:
    a provider that is asked about steps that fail; ``copy_reads``: columns that are still
    not written then are copies of what the step reads. ``check``: look at what the steps
    wrote (one aggregate for all columns that later steps leave alone), report columns that
    are missing, empty or hold error messages, and fill new columns that came out empty; a
    stream is not looked at.
    """
    raw = plan if isinstance(plan, dict) else plan.json() if isinstance(plan, Plan) else json.loads(plan)
    checked = validate_plan(raw, df.columns)
    report = Report(warnings=checked.warnings + checked.errors)
    if mode == "strict" and checked.errors:
        raise PlanError("; ".join(checked.errors))
    plan = Plan.of(raw)
    original = [c for c in df.columns if c != POS]
    if not sanitized:
        plan = sanitize(plan, df)
    if not df.isStreaming:
        df = with_position(df, order_by or ())
    done: list[tuple[Step, dict, DataFrame]] = []
    for step in plan.steps:
        row = {"step_id": step.step_id, "op": step.op, "status": "ok", "notes": []}
        report.steps.append(row)
        if step.op in SKIPPED:
            row["status"] = "skipped"
            continue
        ctx = Context("strict" if mode == "strict" else "lenient")
        try:
            df = run_step(df, step, plan, ctx)
        except Exception as e:  # a step's failure is reported, whatever it is
            if mode == "strict":
                raise
            error = f"{type(e).__name__}: {str(e).splitlines()[0][:300]}"
            row["status"], row["notes"] = "failed", [error]
            out = replaced(df, step, plan, code, error)
            if out is not None:
                df, row["status"] = out, "replaced"
                done.append((step, row, df))
            elif copy_reads:
                there = [c for c in step.reads if c in df.columns]
                df = df.withColumns({w: q(there[0]) for w in step.writes if w not in df.columns}) if there else df
            continue
        row["notes"] += ctx.notes
        done.append((step, row, df))
        gone = [w for w in step.writes if w not in df.columns]
        if gone and get(step.op).kind != "rows":
            row["status"] = "incomplete"
            row["notes"].append(f"not written: {gone}")
    if check and not df.isStreaming:
        new = [c for c in df.columns if c not in original and c != POS]
        df = fill_empty(df, plan, original, report_outputs(done, df, new))
    if finalize:
        df = sql_ready(project(df, plan, original)) if not df.isStreaming else project(df, plan, original)
    return df, report


#: What a text that is an error message holds.
ERROR_WORDS = "ERROR|error|Error"
#: Operators besides those of kind "rows" after which other rows may be there.
FEWER_ROWS = ("deduplicate_rows", "sort")


def looked_at(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """What is wrong with columns of a table that has rows: no value, or error messages in texts. One aggregate."""
    if not columns:
        return {}
    texts = {c for c, kind in df.dtypes if kind == "string"}
    cells = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        cells += [F.count(q(c)).alias(f"v{i}"), F.max(q(c).rlike(ERROR_WORDS) if c in texts else F.lit(False)).alias(f"e{i}")]
    r = df.agg(*cells).first()
    return {c: ["empty"] * bool(r["n"] and not r[f"v{i}"]) + ["holds error messages"] * bool(r[f"e{i}"]) for i, c in enumerate(columns)}


def check_output(df: DataFrame, step: Step) -> list[str]:
    """What is wrong with a step's output: columns missing, without values, or that hold error messages."""
    found = looked_at(df, [w for w in step.writes if w in df.columns])
    return [f"{w}: missing" for w in step.writes if w not in df.columns] + [f"{w}: {x}" for w in found for x in found[w]]


def report_outputs(done: list[tuple[Step, dict, DataFrame]], last: DataFrame, new: list[str]) -> list[str]:
    """Add to each step's report what is wrong with its output; returns which of the ``new`` columns are empty in the end.

    A column that no later step writes or drops rows of is looked at in the last table, all such
    columns in one aggregate; the others, in the table after their step.
    """
    later: set[str] = set()
    moved = False
    final: list[tuple[dict, str]] = []

    def note(row: dict, column: str, found: list[str]) -> None:
        if found:
            row["notes"] += [f"{column}: {x}" for x in found]
            row["status"] = "issues" if row["status"] in ("ok", "replaced") else row["status"]

    for step, row, df in reversed(done):
        own = [w for w in step.writes if w in df.columns]
        stay = [w for w in own if not moved and w not in later and w in last.columns]
        final += [(row, w) for w in stay]
        for w, found in looked_at(df, [w for w in own if w not in stay]).items():
            note(row, w, found)
        # a replacement may do anything to the rows
        moved |= row["status"] == "replaced" or get(step.op) is None or get(step.op).kind == "rows" or get(step.op).name in FEWER_ROWS
        later |= set(step.writes)
    found = looked_at(last, list(dict.fromkeys([*new, *(w for _, w in final)])))
    for row, w in final:
        note(row, w, found[w])
    return [c for c in new if "empty" in found[c]]


#: Parts of the names of empty columns that tell how to fill them, and a number in a text.
NUMERIC_NAMES, FLAG_NAMES = ("numeric", "value", "count", "amount", "total"), ("is_", "has_", "flag")
FIRST_NUMBER = r"\d+\.?\d*"


def fill_empty(df: DataFrame, plan: Plan, original: list[str], empty: list[str] | None = None) -> DataFrame:
    """New columns without any value: by the first number of their source, or by whether a text holds what a condition asks for.

    ``empty``: which ones they are, if that is known.
    """
    if empty is None:
        new = [c for c in df.columns if c not in original and c != POS]
        empty = [c for c, found in looked_at(df, new).items() if "empty" in found]
    made = {}
    for c in empty:
        step = next((s for s in plan.steps if c in s.writes), None)
        if step is None:
            continue
        if any(w in c.lower() for w in NUMERIC_NAMES):
            made[c] = _first_number(df, step.params.get("col"))
        elif any(w in c.lower() for w in FLAG_NAMES):
            made[c] = _holds(df, c, [t for x in step.params.get("conditions") or step.params.get("cases") or [] if isinstance(x, dict) for t in expr.sought(str(x.get("condition", x.get("if", ""))), df.columns)])
    made = {k: v for k, v in made.items() if v is not None}
    return df.withColumns(made) if made else df


def _first_number(df: DataFrame, source) -> Column | None:
    if not isinstance(source, str) or source not in df.columns:
        return None
    digits = F.regexp_extract(F.replace(q(source).cast("string"), F.lit(","), F.lit("")), FIRST_NUMBER, 0)
    return F.nullif(digits, F.lit("")).cast("double")


def _holds(df: DataFrame, own: str, texts: list[str]) -> Column | None:
    """Whether the first text column with any of these texts holds the last one that any column has. One aggregate."""
    columns = [x for x, kind in df.dtypes if kind == "string" and x != own]
    if not texts or not columns:
        return None
    tests = [[F.coalesce(q(x).rlike("(?i)" + tx.java(t)), F.lit(False)) for x in columns] for t in texts]
    r = df.agg(*[F.max(cell).alias(f"t{i}_{j}") for i, row in enumerate(tests) for j, cell in enumerate(row)]).first()
    hits = [cell for i, row in enumerate(tests) for cell in [next((cell for j, cell in enumerate(row) if r[f"t{i}_{j}"]), None)] if cell is not None]
    return hits[-1] if hits else None
