import json

import pytest

from tabloom import profile
from tabloom.plans import Plan, PlanError, Step, check_output, execute, fill_empty, sanitize, validate_plan
from tabloom.plans.schema import prompt
from tabloom.plans.sanitize import missing_reads, separators
from tabloom.position import POS

ATHLETICS = {
    "table_id": "a",
    "steps": [
        {"step_id": "s1", "op": "add_row_id", "reads": [], "writes": ["_row_id"], "params": {}},
        {"step_id": "s2", "op": "parse_number", "reads": ["Best: 54.43 m"], "writes": ["best_m"], "params": {"col": "Best: 54.43 m", "out_value": "best_m"}},
        {"step_id": "s3", "op": "extract_regex", "reads": ["Position"], "writes": ["place"], "params": {"col": "Position", "pattern": r"(\d+)", "out_groups": ["place"]}},
        {"step_id": "s4", "op": "cast_column", "reads": ["place"], "writes": ["place"], "params": {"col": "place", "dtype": "integer"}},
        {"step_id": "s5", "op": "derive_conditional", "reads": ["place"], "writes": ["is_medal"], "params": {"out": "is_medal", "conditions": [{"if": "place <= 3", "then": True}], "default": False}},
    ],
    "final_output": {"primary_key": ["_row_id"], "columns": [{"name": n, "role": r} for n, r in (("_row_id", "canonical"), ("Year", "canonical"), ("place", "derived"), ("is_medal", "derived"), ("Position", "raw_snapshot"), ("Venue", "canonical"))]},
}


@pytest.fixture(scope="module")
def athletics(spark):
    rows = [(1999, "Rome", "1st", "54.43 m"), (2001, "Oslo", "12th (q)", "50"), (2003, None, None, None)]
    return spark.createDataFrame(rows, "Year long, Venue string, Position string, `Best: 54.43 m` string")


def test_a_plan(athletics):
    df, report = execute(athletics, ATHLETICS, mode="strict", order_by=["Year"])
    assert df.columns == ["row_id", "Year", "place", "is_medal", "Venue"]
    assert [tuple(r) for r in df.orderBy("row_id").collect()] == [(1, 1999, 1, True, "Rome"), (2, 2001, 12, False, "Oslo"), (3, 2003, None, False, None)]
    assert report.completion == 1.0 and json.loads(report.json())["steps"][0]["status"] == "ok"


def test_exploded_rows(spark):
    races = spark.createDataFrame([("1", "A\nB", "Ford", 30), ("Ret", "C", "Audi", 12)], "Pos string, `Co-Drivers` string, Car string, Laps long")
    plan = {
        "steps": [
            {"step_id": "s1", "op": "split_multi_value", "reads": ["Co-Drivers"], "writes": ["driver", "n"], "params": {"col": "Co-Drivers", "separators": ["\n"], "value_out": "driver", "count_out": "n"}},
            {"step_id": "s2", "op": "derive_conditional", "reads": ["Pos"], "writes": ["is_classified"], "params": {"out": "is_classified", "conditions": [{"if": "Pos != 'Ret' or Pos != 'DNF'", "then": True}], "default": False}},
        ],
        "final_output": {"columns": [{"name": n} for n in ("Pos", "driver", "n", "Car", "is_classified")]},
    }
    df, _ = execute(races, plan, mode="strict")
    assert sorted(tuple(r) for r in df.collect()) == [("1", "A", 2, "Ford", True), ("1", "B", 2, "Ford", True), ("Ret", "C", 1, "Audi", True)]


def test_failing_steps_are_reported(athletics):
    plan = {"steps": [{"step_id": "a", "op": "no_such", "reads": [], "writes": ["x"], "params": {}}, {"step_id": "b", "op": "cast_column", "reads": [], "writes": [], "params": {"col": "none", "dtype": "int"}}, {"step_id": "c", "op": "custom", "reads": [], "writes": ["x"], "params": {"description": "x", "out_cols": ["x"], "code_hint": "import os"}}]}
    df, report = execute(athletics, plan)
    assert [s["status"] for s in report.steps] == ["failed", "ok", "issues"] and "x: empty" in report.steps[2]["notes"] and report.steps[1]["notes"] and report.steps[2]["notes"]
    assert df.columns == ["Year", "Venue", "Position", "Best_54_43_m"]  # x is empty and goes
    with pytest.raises((PlanError, ValueError)):
        execute(athletics, plan, mode="strict")


@pytest.mark.parametrize(
    ("plan", "text"),
    [
        ({}, "no steps"), ({"steps": 1}, "not a list"), ({"steps": []}, "empty"), ({"steps": [3]}, "not an object"), ({"steps": [{"op": "select"}]}, "no step_id"),
        ({"steps": [{"step_id": "a", "op": "select", "reads": "x", "writes": [], "params": {}}]}, "reads is not a list"), ({"steps": [{"step_id": "a", "op": "rename", "reads": [], "writes": [], "params": {}}]}, "needs 'col_map'"),
    ],
)
def test_errors(plan, text):
    v = validate_plan(plan)
    assert not v.ok and any(text in e for e in v.errors)


def test_warnings_and_aliases():
    def step(op, **params):
        return {"steps": [{"step_id": "a", "op": op, "reads": ["Y"], "writes": ["z"], "params": params}]}

    assert validate_plan(step("rename", mapping={"a": "b"}), ["y"]).ok
    assert not validate_plan(step("rename", mapping={"a": "b"}), ["y"]).warnings
    assert validate_plan(step("replace_value", columns=["a"], mapping={}), ["x"]).ok
    assert any("reads 'Y'" in w for w in validate_plan(step("rename", mapping={}), ["x"]).warnings)
    assert any("not known" in w for w in validate_plan(step("nothing"), ["y"]).warnings)
    assert any("does not know 'zzz'" in w for w in validate_plan(step("sort", by="a", zzz=1), ["y"]).warnings)
    assert validate_plan(step("derive_math", expr="a + 1"), ["y"]).ok
    assert "| sort | by | ascending |" in prompt()


def test_rewrites(spark, athletics):
    p = Plan.of({"steps": [{"step_id": "1", "op": "split_multi_value", "params": {"separators": "+"}}, {"step_id": "2", "op": "sort", "reads": ["year", "the_venue", "best:_54.43_m"], "params": {"by": "year"}}]})
    assert separators(p).steps[0].params["separators"] == [" and ", " & ", "\n", "+", ",", "/", ";"]
    got = missing_reads(p, ["Year", "Venue", "Best: 54.43 m"])
    assert got.steps[0].op == "rename" and got.steps[0].params["col_map"] == {"Year": "year", "Best: 54.43 m": "best:_54.43_m"}
    p = Plan.of({"steps": [{"step_id": "1", "op": "rename", "params": {"col_map": {"Year": "y"}}, "writes": ["y"]}, {"step_id": "2", "op": "sort", "reads": ["venue"]}]})
    assert missing_reads(p, ["Year", "Venue"]).steps[0].params["col_map"] == {"Venue": "venue", "Year": "y"}
    dated = spark.createDataFrame([("March 3",), ("May 5, 2001",), ("June 1",), ("July 9",)], "d string")
    p = Plan.of({"steps": [{"step_id": "1", "op": "parse_date_text", "writes": ["when", "d_year"], "params": {"col": "d", "out_date": "when", "default_year": 2000, "out_parts": ["year", "month"]}}], "final_output": {"columns": [{"name": "when", "role": "derived"}, {"name": "_row_id", "role": "canonical"}, {"name": "d", "role": "raw_snapshot"}]}})
    s = sanitize(p, dated)
    assert s.steps[0].writes == ["when"] and s.steps[0].params == {"col": "d", "out_date": "when", "out_parts": ["month"]}
    assert s.steps[1].op == "select" and s.steps[1].params["cols"] == ["_row_id", "when"]
    p = Plan.of({"steps": [{"step_id": "1", "op": "select", "params": {"cols": ["d", "when"]}}], "final_output": {"columns": [{"name": "d", "role": "raw_snapshot"}]}})
    assert sanitize(p, dated).steps[0].params["cols"] == ["when"]


def test_final_columns_fall_back(spark):
    df = spark.createDataFrame([(1, "2", "3", "4", "5.5", "x")], "a long, b string, c string, d_raw string, e string, `f g` string")
    plan = {"steps": [{"step_id": "1", "op": "trim_whitespace", "reads": ["b"], "writes": ["b"], "params": {"cols": ["b"]}}, {"step_id": "2", "op": "select", "reads": [], "writes": [], "params": {"cols": ["a", "b", "c", "d_raw", "e", "f g"]}}]}
    out, _ = execute(df, plan)
    assert dict(out.dtypes) == {"a": "bigint", "b": "bigint", "c": "bigint", "e": "double", "f_g": "string"}


def test_row_ids_become_unique(spark):
    df = spark.createDataFrame([("a,b",), ("c",)], "s string")
    plan = {"steps": [{"step_id": "1", "op": "add_row_id", "reads": [], "writes": [], "params": {}}, {"step_id": "2", "op": "split_multi_value", "reads": [], "writes": ["s"], "params": {"col": "s", "separators": [","], "value_out": "s"}}]}
    out, _ = execute(df, plan)
    assert sorted(r.row_id for r in out.collect()) == [0, 1, 2]


def test_outputs_checked_and_filled(spark):
    df = spark.createDataFrame([(None, None, "1,200 m", "an error", 0), (None, None, "30", "Champion", 1)], f"total double, is_champ string, s string, m string, {POS} long")
    step = Step("a", "custom", writes=["total", "gone", "m"], params={"col": "s"})
    assert check_output(df, step) == ["gone: missing", "total: empty", "m: holds error messages"]
    plan = Plan(steps=[step, Step("b", "derive_conditional", writes=["is_champ"], params={"conditions": [{"if": "m contains 'champ'"}]})])
    out = fill_empty(df, plan, ["s", "m"])
    assert [(r.total, r.is_champ) for r in out.orderBy(POS).collect()] == [(1200.0, False), (30.0, True)]


def test_profile(spark):
    df = spark.createDataFrame([("in 1999", 1), ("2001", 1), (None, 2)], "s string, n long")
    assert [(d["column"], d["n_unique"], d["n_missing"]) for d in profile.stats(df)] == [("s", 2, 1), ("n", 2, 0)]
    assert profile.has_year(df, ["s", "n"]) == {"s": True, "n": False}
    q = spark.createDataFrame([("q1", ["a"], "bad dates"), ("q2", None, " "), ("q3", ["b", "a"], "bad dates"), ("q4", ["c"], "units")], "qid string, depends_on array<string>, failure_reason string")
    got = {r.issue_id: (r.description, r.cols, r.blocking_questions) for r in profile.issues(q).collect()}
    assert got == {"iss_001": ("bad dates", ["a", "b"], ["q1", "q3"]), "iss_002": ("units", ["c"], ["q4"])}
