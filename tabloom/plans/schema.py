"""What the operators of plans take. The names of operators and parameters are fixed values: plans are written with them."""

from __future__ import annotations

from dataclasses import dataclass

from ..operators import get


@dataclass(frozen=True)
class OpSpec:
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()


#: The operators a planner is offered, with required and optional parameters.
OPS = {
    "add_row_id": OpSpec((), ("out",)),
    "rename": OpSpec(("col_map",)),
    "select": OpSpec(("cols",)),
    "parse_date_text": OpSpec(("col", "out_date"), ("out_parts", "formats")),
    "parse_number": OpSpec(("col", "out_value"), ("out_unit", "pattern")),
    "extract_regex": OpSpec(("col", "pattern", "out_groups")),
    "derive_conditional": OpSpec(("out", "conditions"), ("default",)),
    "derive_math": OpSpec(("out", "expr")),
    "map_values": OpSpec(("col", "mapping", "out"), ("default",)),
    "replace_value": OpSpec(("col", "old_value", "new_value")),
    "replace_string": OpSpec(("col", "pattern", "replacement"), ("regex", "writes")),
    "cast_column": OpSpec(("col", "dtype"), ("out",)),
    "fillna_static": OpSpec(("col", "value")),
    "fillna_dynamic": OpSpec(("col", "method"), ("source_col",)),
    "combine_columns": OpSpec(("cols", "out", "sep")),
    "trim_whitespace": OpSpec(("cols",), ("out",)),
    "filter_rows": OpSpec(("condition",)),
    "sort": OpSpec(("by",), ("ascending",)),
    "deduplicate_rows": OpSpec((), ("subset", "keep")),
    "bin_numeric": OpSpec(("col", "bins", "labels", "out")),
    "one_hot": OpSpec(("col",), ("prefix",)),
    "split_multi_value": OpSpec(("col", "separators", "value_out"), ("explode", "count_out")),
    "custom": OpSpec(("description", "out_cols"), ("code_hint",)),
}

#: A required parameter may come under another name.
ALIASES = {
    "rename": {"mapping": "col_map"},
    "derive_conditional": {"cases": "conditions"},
    "map_values": {"cols": "col"},
    "extract_regex": {"column": "col", "input_col": "col", "regex": "pattern", "output_groups": "out_groups", "out": "out_groups", "outputs": "out_groups", "out_cols": "out_groups", "output_cols": "out_groups"},
    "parse_number": {"column": "col", "input_col": "col", "output_value": "out_value", "output_unit": "out_unit", "out": "out_value"},
    "parse_date_text": {"column": "col", "input_col": "col", "out_col": "out_date", "output_date": "out_date", "out": "out_date"},
    "replace_value": {"column": "col", "input_col": "col", "columns": "col"},
    "replace_string": {"column": "col", "input_col": "col", "out": "col"},
    "cast_column": {"column": "col", "input_col": "col"},
    "derive_math": {"output": "out", "output_col": "out", "result": "out"},
    "fillna_static": {"column": "col", "columns": "col"},
    "fillna_dynamic": {"column": "col", "columns": "col"},
}
#: Other sets of required parameters.
MODES = {"replace_value": (("columns", "mapping"), ("col", "mapping")), "parse_date_text": (("col",),)}


def known(op: str) -> bool:
    return op in OPS or get(op) is not None


def missing(op: str, params: dict, writes: list | None = None) -> list[str]:
    """Required parameters that are there under no name. An output that is the only column written need not be named."""
    spec = OPS.get(op)
    if spec is None:
        return []
    names = set(params) | {ALIASES.get(op, {}).get(p, p) for p in params}
    for mode in MODES.get(op, ()):
        if set(mode) <= names:
            return []
    told = {"out"} if len(writes or []) == 1 else set()
    return [p for p in spec.required if p not in names | told]


def unexpected(op: str, params: dict) -> list[str]:
    spec, own = OPS.get(op), get(op)
    if spec is None or own is None:
        return []
    import inspect

    takes = inspect.signature(own.run).parameters
    if any(p.kind is p.VAR_KEYWORD for p in takes.values()):
        return []
    return [p for p in params if p not in spec.required + spec.optional and p not in ALIASES.get(op, {}) and p not in own.aliases and p not in takes]


def prompt() -> str:
    """The operators as a table, for whoever writes plans."""
    rows = ["| op | required | optional |", "| --- | --- | --- |"]
    return "\n".join(rows + [f"| {k} | {', '.join(v.required) or '(none)'} | {', '.join(v.optional) or '(none)'} |" for k, v in OPS.items()])
