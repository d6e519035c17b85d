import json

import pytest
from pyspark.sql import functions as F

from tabloom import providers, qa
from tabloom.functions import score as sc
from tabloom.plans import PlanError
from tabloom.position import POS
from tabloom.sources import dataset, hierarchical, load_dataset, load_metadata, markdown, read_csv, read_hierarchical, read_markdown, to_markdown, write_csv
from tabloom import streaming


def test_markdown(spark):
    content = "# title\n| A | Gold | Gold |\n|---|:-:|---|\n| 1 | x |\n| two\nlines | y | z | w |\n"
    assert markdown.parse(content) == (["A", "Gold", "Gold_name", "column_4"], [["1", "x", "", ""], ["two lines", "y", "z", "w"]])
    assert markdown.parse("no table") is None and markdown.parse("| only |") is None
    df = read_markdown(spark, content)
    assert [r.A for r in df.orderBy(POS).collect()] == ["1", "two lines"] and df.orderBy(POS).first().Gold_name is None
    assert to_markdown(df.select("A", "Gold", POS), 1) == "| A | Gold |\n| --- | --- |\n| 1 | x |"
    cells = markdown.explode_tables(spark.createDataFrame([("t", content), ("u", None)], "table_id string, markdown string"))
    assert cells.count() == 8 and {r.name for r in cells.collect()} == {"A", "Gold", "Gold_name", "column_4"}
    with pytest.raises(ValueError):
        read_markdown(spark, "x")


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n,N,x,flag,s\n1,2.5,NA,True,"a ""q"", b"\n,3,,False,None\n')
    df = read_csv(spark, str(tmp_path / "a.csv"))
    assert dict(df.drop(POS).dtypes) == {"n": "bigint", "N_1": "double", "x": "string", "flag": "boolean", "s": "string"}
    assert tuple(df.orderBy(POS).drop(POS).collect()[0]) == (1, 2.5, None, True, 'a "q", b') and df.where("s is null").count() == 1
    write_csv(df, str(tmp_path / "out"))
    assert read_csv(spark, str(tmp_path / "out")).count() == 2
    write_csv(df, str(tmp_path / "one.csv"), bom=True)
    assert (tmp_path / "one.csv").read_bytes().startswith(b"\xef\xbb\xbf")


def test_datasets(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"question": "q?", "answers": ["x"]}]))
    (tmp_path / "a.md").write_text("| a |\n| - |\n| 1 |")
    (tmp_path / "b.json").write_text(json.dumps({"table_id": "B", "csv_path": "b.csv", "questions": [{"qid": "z", "text": "t", "ground_truth": "y"}]}))
    (tmp_path / "c.json").write_text(json.dumps({"questions": []}))
    got = load_dataset(str(tmp_path))
    assert [e["table_id"] for e in got] == ["a", "B"] and got[0]["questions"][0] == {"qid": "q1", "text": "q?", "ground_truth": ["x"]} and got[1]["questions"][0]["ground_truth"] == ["y"]
    (tmp_path / "m.jsonl").write_text('{"table_id": "t1", "k": 1}\n{"table_id": "t2", "k": 2}\n')
    meta = load_metadata(str(tmp_path / "m.jsonl"))
    assert meta["t2"]["k"] == 2 and dataset.metadata_of(meta, "xt2")["k"] == 2 and dataset.metadata_of(meta, "none") is None


def test_hierarchical(spark, tmp_path):
    def node(name, line=None, *children):
        return {"name": name, "line_idx": line, "children_dict": list(children)}

    t = {"top_root": node("root", None, node("A", None, node("x", 0), node("y", 1)), node("B", 2)), "left_root": node("root", None, node("L", 0, node("M", 1))), "data": [[{"value": 1}, {"value": "2"}, {"value": None}, {"value": 9}], [{"value": 4}], [{"value": 5}]]}
    rows = [tuple(r) for r in read_hierarchical(spark, json.dumps(t)).orderBy(POS).collect()]
    assert rows == [("L", "1", "2", None, None, 0), ("L", "4", None, None, "M", 1), (None, "5", None, None, None, 2)]
    (tmp_path / "t.json").write_text(json.dumps(t))
    assert hierarchical.read_corpus(spark, str(tmp_path)).count() == 8


def test_csv_files_that_are_split(spark, tmp_path):
    """Large input is not read file by file; types and missing words are the same."""
    (tmp_path / "a.csv").write_text('n,s\n1,"x, y"\n2,N/A\n', encoding="utf-8")
    for whole in (True, False, None):
        df = read_csv(spark, str(tmp_path / "a.csv"), whole_files=whole, positions=False)
        assert [tuple(r) for r in df.orderBy("n").collect()] == [(1, "x, y"), (2, None)] and dict(df.dtypes)["n"] == "bigint"


def test_sql(spark):
    df = spark.createDataFrame([(1, "Ab", True), (2, None, False)], "n long, `full name` string, b boolean")
    assert qa.answer(df, "t 1", 'SELECT "full name" FROM t_1 WHERE "full name" LIKE \'aB\'') == ("Ab", None)
    assert qa.answer(df, "t", "SELECT n, b FROM t WHERE n = 1;") == ("1 | 1", None)
    assert qa.answer(df, "t", "WITH x AS (SELECT max(n) AS m FROM t) SELECT m FROM x") == ("2", None)
    assert qa.answer(df, "t", "SELECT `full name` FROM t WHERE n = 2") == ("NULL", None)
    assert qa.answer(df, "t", "SELECT n FROM t WHERE n > 5") == ("EMPTY", None)
    assert qa.answer(df, "t", "SELECT 1") == ("", qa.NO_SQL) and qa.answer(df, "t", "")[1] and qa.answer(df, "t", "SELECT nothing FROM t")[1]
    many = spark.range(20).withColumnRenamed("id", "n")
    assert qa.answer(many, "m", "SELECT n FROM m ORDER BY n")[0] == ", ".join(map(str, range(10)))
    assert qa.column_descriptions(df).splitlines() == ["- n (INTEGER): 1, 2", "- full name (TEXT): Ab", "- b (INTEGER): True, False"]
    got = qa.answer_batch(df, "t", [{"qid": "a", "text": "how many?", "ground_truth": ["2"]}, {"qid": "b", "text": "?", "ground_truth": ["x"]}], providers.FixedSql({"how many?": "SELECT count(*) FROM t"}))
    assert [g["correct"] for g in got] == [[True, 1.0], [False, 0.0]] and got[1]["failure_reason"] == qa.NO_SQL
    s = qa.summary(spark.createDataFrame([("t", True, 1.0), ("t", False, 0.5)], "table_id string, exact_match boolean, f1 double")).first()
    assert (s.n, s.exact, s.exact_percent, s.mean_f1) == (2, 1, 50.0, 0.75)


@pytest.mark.parametrize(
    ("a", "b", "em", "f1"),
    [
        ("2018-01-05", ["5 January 2018"], True, 1.0), ("1,234.0", ["1234"], True, 1.0), ("Jan", ["January"], True, 1.0), ("1st", ["first"], True, 1.0), ("iv", ["4"], True, 1.0), ("yes", ["true"], True, 1.0),
        ("45%", ["45 percent"], True, 1.0), ("$5", ["5"], True, 1.0), ("-5", ["5"], True, 1.0), ("b and a", ["a", "b"], True, 1.0), ("3.004", ["3.0"], False, 1.0), ("the answer is 'x'", ["X"], True, 1.0), ("a b", ["b c"], False, 0.5),
        ("x", [], False, 0.0), ("", [], True, 1.0), ("a, b", ["a", "b"], True, 1.0),
    ],
)
def test_scores(spark, a, b, em, f1):
    assert sc.score(spark, a, b) == (em, f1)


def test_providers(tmp_path):
    assert providers.read_json('```json\n{"a": 1,}\n```') == {"a": 1}
    assert providers.read_json("so: {'x': 1}".replace("'x'", '"x"')) == {"x": 1}
    assert providers.read_json('[{"a": 1}, {"a": 2}]') == [{"a": 1}, {"a": 2}]
    assert providers.clean_json('{"a": "é"} and {"b": 2}') == '{"a": "é"}'
    loose = [
        ("{'a': 'it's', \"b\": [1 2, 3,], c: True}", {"a": "it's", "b": ["1 2", 3], "c": True}),
        ('{"a": {"b": 1} {"c": 2}', {"a": {"b": 1}, "c": 2}),
        ('[{"a": 1} {"a": 2}, ]', [{"a": 1}, {"a": 2}]),
        ('plan:\n{"steps": [{"op": "x"}, {"op": "y"', {"steps": [{"op": "x"}, {"op": "y"}]}),
        ('{"a": "two\nlines", "b": "q\\"\\u00e9\\d", "c": None, "d": , "e": -1.5e3}', {"a": "two\nlines", "b": 'q"éd', "c": None, "d": None, "e": -1500.0}),
        ('{"a": "say "hi" to", "b": "x"}', {"a": 'say "hi" to', "b": "x"}),
        ("[}]:[]", []),
    ]
    for text, want in loose:
        assert providers.read_json(text) == want, text
    with pytest.raises(ValueError):
        providers.read_json("no json here")
    assert providers.extract_sql("<reasoning>why</reasoning>```sql\nSELECT a FROM t;\n```") == ("SELECT a FROM t", "why")
    assert providers.extract_sql("WITH x AS (SELECT 1) SELECT * FROM x;")[0].startswith("WITH x")
    assert providers.extract_sql("I think SELECT a FROM t\n\nbecause")[0] == "SELECT a FROM t" and providers.extract_sql("none") == ("", "")
    (tmp_path / "t.json").write_text('{"steps": []}')
    assert providers.FilePlans(str(tmp_path)).plan("t", None, []) == {"steps": []} and providers.FilePlans(str(tmp_path)).plan("u", None, []) is None
    calls, waits = [], []

    def f():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("busy")
        return "ok"

    assert providers.retried(f, wait=1, sleep=waits.append)() == "ok" and waits == [1, 2]


def test_streams(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    plan = {"steps": [{"step_id": "a", "op": "extract_regex", "writes": ["k"], "params": {"col": "props", "pattern": r"(\d+)", "out_groups": ["k"]}}, {"step_id": "b", "op": "cast_column", "params": {"col": "k", "dtype": "int"}}, {"step_id": "c", "op": "filter_rows", "params": {"condition": "k > 50"}}]}
    q = streaming.write(streaming.transform(stream, plan), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    want = events.where(F.regexp_extract("props", r"(\d+)", 1).cast("int") > 50).count()
    assert spark.read.parquet(str(tmp_path / "out")).count() == want > 0
    for op, p in (("add_row_id", {}), ("one_hot", {"col": "event_type"}), ("nothing", {})):
        with pytest.raises(PlanError):
            streaming.transform(stream, {"steps": [{"step_id": "a", "op": op, "params": p}]})
    w = streaming.windowed(stream, "ts", "1 day", "2 days", ["event_type"], total="value").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    w.awaitTermination(120)
    assert spark.sql("SELECT sum(n) FROM w").first()[0] == events.count()
