"""Registered queries of plans: their checks and rewrites, other names, reports, repairs, and scripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .plans import Plan, execute, validate_plan
from .plans.emit import script
from .position import POS
from .queries import PLAN, PLANNED, query
from .session import scratch
from .sources import write_csv


@query(
    "SELECT * FROM (VALUES ('fine', 0, 0), ('no steps', 1, 0), ('empty steps', 1, 0), ('no list', 1, 0), ('missing fields', 3, 0), ('wrong types', 2, 0), ('missing parameter', 1, 0), ('other name', 0, 0), ('other mode', 0, 0),"
    " ('unknown operator', 0, 1), ('unknown read', 0, 1), ('unknown parameter', 0, 1)) t(plan, errors, warnings)"
)
def plan_validation(spark, read):
    """Plans with each sort of fault, by the number of errors and warnings."""
    step = {"step_id": "s", "op": "trim_whitespace", "reads": ["n_name"], "writes": [], "params": {"cols": ["n_name"]}}

    def one(**other):
        return {"steps": [{**step, **other}]}

    plans = {
        "fine": one(),
        "no steps": {"table_id": "x"},
        "empty steps": {"steps": []},
        "no list": {"steps": "s"},
        "missing fields": {"steps": [{"step_id": "s", "op": "select"}]},
        "wrong types": one(reads="n_name", params=[]),
        "missing parameter": one(params={}),
        "other name": one(op="cast_column", params={"column": "n_name", "dtype": "string"}),
        "other mode": one(op="replace_value", params={"columns": ["n_name"], "mapping": {}}),
        "unknown operator": one(op="no_such"),
        "unknown read": one(reads=["nothing"]),
        "unknown parameter": one(params={"cols": ["n_name"], "speed": 3}),
    }
    columns = read("nation").columns
    checked = {k: validate_plan(p, columns) for k, p in plans.items()}
    return spark.createDataFrame([(k, len(v.errors), len(v.warnings)) for k, v in checked.items()], "plan string, errors int, warnings int")


@query("SELECT p_partkey AS part_key, unnest(string_split(p_name, ' ')) AS word, 5 AS d_month FROM part")
def plan_rewrites(spark, read):
    """What plans get without asking: common separators, no year of dates without one, raw columns of nearly the name, no snapshots in selects."""
    plan = {
        "steps": [
            {"step_id": "a", "op": "split_multi_value", "reads": ["part_name"], "writes": ["word"], "params": {"col": "part_name", "separators": ["+"], "value_out": "word"}},
            {"step_id": "b", "op": "parse_date_text", "reads": ["d"], "writes": ["d_month", "d_year"], "params": {"col": "d", "out_date": "when", "out_parts": ["month", "year"], "default_year": 1999}},
            {"step_id": "c", "op": "map_values", "reads": ["d"], "writes": ["d_month"], "params": {"col": "d", "out": "d_month", "mapping": {"May 3": "5"}}},
            {"step_id": "z", "op": "select", "reads": [], "writes": [], "params": {"cols": ["part_key", "word", "d_month", "raw"]}},
        ],
        "final_output": {"columns": [{"name": n, "role": r} for n, r in (("part_key", "canonical"), ("word", "derived"), ("d_month", "derived"), ("raw", "raw_snapshot"))]},
    }
    df = read("part").select(F.col("p_partkey").alias("part_key"), F.regexp_replace("p_name", " ", " & ").alias("Part Name"), F.lit("May 3").alias("d"), F.lit("kept out").alias("raw"))
    return execute(df, plan, order_by=["part_key"])[0]


@query(
    "SELECT c_custkey, c_custkey::VARCHAR AS as_text, CASE WHEN c_acctbal > 0 THEN 'up' ELSE 'down' END AS side, c_acctbal / 2 AS half, regexp_extract(c_name, '#0*(\\d+)', 1) AS num, CASE WHEN c_mktsegment = 'BUILDING' THEN 'B' ELSE c_mktsegment END AS seg FROM customer"
)
def plan_aliases(spark, read):
    """Parameters and operators under their other names."""
    plan = {
        "steps": [
            {"step_id": "a", "op": "cast_column", "reads": ["c_custkey"], "writes": ["as_text"], "params": {"column": "c_custkey", "dtype": "str", "out": "as_text"}},
            {"step_id": "b", "op": "derive_conditional", "reads": ["c_acctbal"], "writes": ["side"], "params": {"out": "side", "cases": [{"if": "c_acctbal > 0", "then": "up"}], "default": "down"}},
            {"step_id": "c", "op": "derive_math", "reads": ["c_acctbal"], "writes": ["half"], "params": {"output_col": "half", "expr": "c_acctbal / 2"}},
            {"step_id": "d", "op": "extract_regex", "reads": ["c_name"], "writes": ["num"], "params": {"input_col": "c_name", "regex": r"#0*(\d+)", "output_groups": ["num"]}},
            {"step_id": "e", "op": "rename", "reads": ["c_mktsegment"], "writes": ["seg"], "params": {"mapping": {"c_mktsegment": "seg"}}},
            {"step_id": "f", "op": "replace_value", "reads": ["seg"], "writes": ["seg"], "params": {"columns": "seg", "mapping": {"BUILDING": "B"}}},
            {"step_id": "z", "op": "project", "reads": [], "writes": [], "params": {"columns": ["c_custkey", "as_text", "side", "half", "num", "seg"]}},
        ]
    }
    df, _ = execute(read("customer"), plan, mode="strict", order_by=["c_custkey"], finalize=False)
    return df.drop(POS)


#: A plan whose steps come out well, empty, with error messages, without what they should write, and not at all.
CHECKED = {
    "steps": [
        {"step_id": "fine", "op": "cast_column", "reads": ["o_custkey"], "writes": ["as_text"], "params": {"col": "o_custkey", "dtype": "string", "out": "as_text"}},
        {"step_id": "empty", "op": "parse_pattern", "reads": ["o_orderpriority"], "writes": ["total"], "params": {"col": "o_orderpriority", "pattern": "(none of this)", "output_cols": ["total"]}},
        {"step_id": "flag", "op": "parse_pattern", "reads": ["o_orderpriority"], "writes": ["is_low"], "params": {"col": "o_orderpriority", "pattern": "(nor of this)", "output_cols": ["is_low"], "conditions": [{"if": "o_orderpriority contains 'low'"}]}},
        {"step_id": "errors", "op": "derive_conditional", "reads": ["o_orderstatus"], "writes": ["said"], "params": {"out": "said", "conditions": [{"if": "o_orderstatus = 'F'", "then": "an error"}], "default": "ok"}},
        {"step_id": "missing", "op": "sanitize_text", "reads": ["o_orderstatus"], "writes": ["nowhere"], "params": {"cols": ["o_orderstatus"]}},
        {"step_id": "fails", "op": "no_such", "reads": [], "writes": [], "params": {}},
        {"step_id": "fewer", "op": "filter_rows", "reads": ["o_orderstatus"], "writes": [], "params": {"condition": "o_orderstatus != 'P'"}},
    ]
}


@query("SELECT o_orderkey, o_orderpriority[1]::DOUBLE AS total, o_orderpriority ILIKE '%low%' AS is_low FROM orders WHERE o_orderstatus <> 'P'")
def plan_fills_empty_columns(spark, read):
    """New columns that came out empty: by the first number of their source, and by what their condition looks for."""
    df, _ = execute(read("orders"), CHECKED, order_by=["o_orderkey"], finalize=False)
    return df.select("o_orderkey", "total", "is_low")


@query(
    "SELECT 'fine' AS step_id, CASE WHEN count(o_custkey) > 0 THEN 'ok' ELSE 'issues' END AS status, '' AS notes FROM orders UNION ALL SELECT 'empty', 'issues', 'total: empty' UNION ALL SELECT 'flag', 'issues', 'is_low: empty'"
    " UNION ALL SELECT 'errors', CASE WHEN bool_or(o_orderstatus = 'F') THEN 'issues' ELSE 'ok' END, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'said: holds error messages' ELSE '' END FROM orders"
    " UNION ALL SELECT 'missing', 'incomplete', 'not written: [''nowhere'']' UNION ALL SELECT 'fails', 'failed', 'PlanError: no operator ''no_such''' UNION ALL SELECT 'fewer', 'ok', ''"
)
def plan_checks(spark, read):
    """What becomes of each step of a plan, by its report."""
    _, report = execute(read("orders"), CHECKED, order_by=["o_orderkey"], finalize=False)
    return spark.createDataFrame([(s["step_id"], s["status"], "; ".join(s["notes"])) for s in report.steps], "step_id string, status string, notes string")


@query(PLANNED)
def plan_script(spark, read):
    """The plan as a script of its own, run on the table as a CSV file."""
    folder = scratch(spark)
    write_csv(read("orders"), f"{folder}/in")
    exec(compile(script(Plan.of(PLAN), f"{folder}/in", f"{folder}/out"), "script", "exec"), {})
    return spark.read.parquet(f"{folder}/out").select("o_orderkey", "prio_num", "prio_name", "is_urgent", "order_year", "o_totalprice")
