import json

from tabloom import batch, providers
from tabloom.__main__ import main
from tabloom.plans import Plan, execute
from tabloom.plans.emit import script

TABLE = "| Team | Score |\n| --- | --- |\n| Reds | 1,200 |\n| Blues | 15 |\n"
PLAN = {"steps": [{"step_id": "s1", "op": "parse_number", "description": "numbers", "reads": ["Score"], "writes": ["score_n"], "params": {"col": "Score", "out_value": "score_n"}}], "final_output": {"columns": [{"name": n, "role": "derived"} for n in ("Team", "Score", "score_n")]}}


def dataset(folder):
    folder.mkdir()
    (folder / "one.json").write_text(json.dumps({"table_id": "one", "markdown": TABLE, "questions": [{"qid": "a", "text": "best?", "ground_truth": ["Reds"]}, {"qid": "b", "text": "sum?", "ground_truth": ["1215.0"]}]}))
    (folder / "two.json").write_text(json.dumps([{"id": "c", "question": "how many?", "answers": ["2"]}]))
    (folder / "two.md").write_text(TABLE)
    (folder / "bad.json").write_text(json.dumps({"table_id": "bad", "markdown": "no table", "questions": []}))


SQL = {"best?": "SELECT Team FROM one ORDER BY score_n DESC LIMIT 1", "sum?": "SELECT sum(score_n) FROM one", "how many?": "SELECT count(*) FROM two"}


def test_question_set(spark, tmp_path):
    dataset(tmp_path / "d")
    (tmp_path / "plans").mkdir()
    (tmp_path / "plans" / "one.json").write_text("```json\n" + json.dumps(PLAN) + "\n```")
    total = batch.run(spark, str(tmp_path / "d"), str(tmp_path / "out"), providers.FilePlans(str(tmp_path / "plans")), providers.FixedSql(SQL))
    by = {t["table_id"]: t for t in total["by_table"]}
    assert (by["one"]["status"], by["two"]["status"], by["bad"]["status"]) == ("success", "no_plan", "failed")
    assert total["questions"] == 3 and total["exact"] == 3 and total["mean_f1"] == 1.0
    assert spark.read.parquet(str(tmp_path / "out" / "one" / "final")).columns == ["Team", "Score", "score_n"]
    again = batch.run(spark, str(tmp_path / "d"), str(tmp_path / "out"), providers.FilePlans("none"), providers.FixedSql({}))
    assert {t["table_id"]: t["status"] for t in again["by_table"]}["one"] == "cached"
    gold = tmp_path / "gold.json"
    gold.write_text(json.dumps([{"id": "a", "answer": "Blues"}, {"qid": "b", "answers": ["1215"]}]))
    s = batch.score_files(spark, str(tmp_path / "out" / "one" / "qa_results.json"), str(gold))
    assert (s["n"], s["exact"]) == (2, 1)


def test_invalid_plans_are_asked_for_again(spark, tmp_path):
    class Plans:
        asked: list = []

        def plan(self, table_id, df, questions):
            self.asked.append(questions)
            return {"steps": []} if len(self.asked) == 1 else PLAN

    got = batch.run_table(spark, {"table_id": "one", "markdown": TABLE, "questions": []}, str(tmp_path / "x"), Plans(), providers.FixedSql({}))
    assert got["status"] == "success" and "errors" in Plans.asked[1][-1]


def test_replacements(spark):
    df = spark.createDataFrame([("a", "3")], "x string, y string")
    plan = {"steps": [{"step_id": "s", "op": "mystery", "reads": ["y"], "writes": ["the_year"], "params": {}}]}

    class Code:
        def replace(self, step, df, error):
            return [{"step_id": "r", "op": "copy_and_replace", "params": {"col": "y", "out": "the_year", "replacements": {"3": "2003"}}}]

    out, report = execute(df, plan, code=Code(), finalize=False)
    assert out.first().the_year == 2003 and report.steps[0]["status"] == "replaced"
    out, report = execute(df, plan, copy_reads=True, finalize=False)
    assert out.first().the_year == "3" and report.steps[0]["status"] == "failed"
    out, _ = execute(df, plan, finalize=False)
    assert "the_year" not in out.columns


def test_script_and_commands(spark, tmp_path, capsys):
    csv = tmp_path / "t.csv"
    csv.write_text("Team,Score\nReds,\"1,200\"\nBlues,15\n")
    text = script(Plan.of(PLAN), str(csv), str(tmp_path / "by_script"))
    exec(compile(text, "script", "exec"), {})
    assert [r.score_n for r in spark.read.parquet(str(tmp_path / "by_script")).orderBy("score_n").collect()] == [15, 1200]
    (tmp_path / "p.json").write_text(json.dumps(PLAN))
    assert main(["run", str(csv), str(tmp_path / "p.json"), str(tmp_path / "o")]) == 0
    assert main(["ask", str(tmp_path / "o" / "final.parquet"), "SELECT max(score_n) FROM t"]) == 0
    assert capsys.readouterr().out.strip().splitlines()[-1] == "1200.0"
    assert main(["validate", str(tmp_path / "p.json")]) == 0 and main(["validate", "--schema"]) == 0
    tree = {"top_root": {"name": "r", "children_dict": [{"name": "A", "line_idx": 0}]}, "left_root": {"name": "r", "children_dict": [{"name": "L", "line_idx": 0}]}, "data": [[{"value": 5}]]}
    (tmp_path / "h.json").write_text(json.dumps(tree))
    assert main(["flatten", str(tmp_path / "h.json"), str(tmp_path / "h.csv")]) == 0
    assert (tmp_path / "h.csv").read_text(encoding="utf-8-sig").split() == ["row_level_0,A", "L,5"]
