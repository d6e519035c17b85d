"""Registered queries of files, descriptions, replies, JSON in SQL, and batches of tables."""

from __future__ import annotations

import json
import os
import shutil
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from . import providers, qa
from .position import with_position
from .queries import query, sql_query
from .session import scratch
from .sources import dataset, load_dataset, load_metadata, read_csv, to_markdown, write_csv


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'a, \"b\"' WHEN 1 THEN 'two' || chr(10) || 'lines' WHEN 2 THEN NULL ELSE 'plain' END AS note, o_totalprice AS price, o_orderkey % 2 = 0 AS flag, o_custkey AS price_1 FROM orders")
def csv_round_trip(spark, read):
    """Written and read again: commas, quotes and line breaks in cells, a word for missing values, types by the values."""
    k = F.col("o_orderkey")
    note = F.when(k % 4 == 0, 'a, "b"').when(k % 4 == 1, "two\nlines").when(k % 4 == 2, "N/A").otherwise("plain")
    df = read("orders").select("o_orderkey", note.alias("note"), F.col("o_totalprice").alias("price"), F.when(k % 2 == 0, "True").otherwise("False").alias("flag"), F.col("o_custkey").alias("price_1"))
    folder = f"{scratch(spark)}/csv"
    write_csv(df, folder)
    return read_csv(spark, folder, whole_files=True, positions=False)


@query("SELECT n_nationkey AS key, n_name AS name, lower(n_name) AS Name_1, n_regionkey AS column_4, 'x' AS name_2 FROM nation")
def csv_column_names(spark, read):
    """A header with a name twice, in another case, and a blank one; files that Spark may split."""
    n = read("nation").select(F.concat_ws(",", "n_nationkey", "n_name", F.lower("n_name"), "n_regionkey", F.lit("x")).alias("line"))
    folder = f"{scratch(spark)}/csv"
    spark.createDataFrame([("key,name,Name,,name",)], "line string").union(n).coalesce(1).write.text(folder)
    return read_csv(spark, folder, whole_files=False, positions=False)


@query("SELECT n_regionkey::VARCHAR AS table_id, CASE n_regionkey % 2 WHEN 0 THEN 'markdown' ELSE 'csv_path' END AS kind, n_nationkey::VARCHAR AS qid, 'key of ' || n_name || '?' AS text, [n_nationkey::VARCHAR] AS ground_truth FROM nation")
def question_sets(spark, read):
    """Files of questions of both forms: lists with a table beside them, and objects that name their table."""
    folder = tempfile.mkdtemp(prefix="questions-")
    by: dict[int, list] = {}
    for n in read("nation").orderBy("n_nationkey").collect():
        by.setdefault(n.n_regionkey, []).append(n)
    for k, own in by.items():
        asked = [{"id": n.n_nationkey, "question": f"key of {n.n_name}?", "answer": n.n_nationkey} if k % 2 == 0 else {"qid": str(n.n_nationkey), "text": f"key of {n.n_name}?", "ground_truth": [n.n_nationkey]} for n in own]
        with open(f"{folder}/{k}.json", "w", encoding="utf-8") as f:
            json.dump(asked if k % 2 == 0 else {"table_id": k, "questions": asked, "csv_path": f"{k}.csv"}, f)
        with open(f"{folder}/{k}.{'md' if k % 2 == 0 else 'csv'}", "w", encoding="utf-8") as f:
            f.write("| a |\n|---|\n| 1 |\n")
    rows = [(e["table_id"], next(x for x in ("markdown", "csv_path") if e.get(x)), x["qid"], x["text"], x["ground_truth"]) for e in load_dataset(folder) for x in e["questions"]]
    shutil.rmtree(folder)
    return spark.createDataFrame(rows, "table_id string, kind string, qid string, text string, ground_truth array<string>")


@query("SELECT conv_id::VARCHAR AS table_id, turn::VARCHAR AS qid, text, [role] AS ground_truth FROM conversations")
def question_lines(spark, read):
    """Questions in JSON lines, read by Spark."""
    folder = f"{scratch(spark)}/questions"
    read("conversations").select(F.col("conv_id").cast("string").alias("table_id"), F.col("turn").cast("string").alias("qid"), "text", F.array("role").alias("ground_truth")).write.json(folder)
    return dataset.questions(spark, folder)


@query("SELECT form, r_regionkey::VARCHAR AS table_id, CASE WHEN form = 'near' THEN 'region ' || r_name ELSE r_name END AS description FROM region, (VALUES ('object'), ('array'), ('lines'), ('near')) f(form)")
def column_metadata(spark, read):
    """Descriptions from an object, an array and lines; an id that only holds the wanted one is found too."""
    folder = tempfile.mkdtemp(prefix="metadata-")
    own = [(str(r.r_regionkey), r.r_name) for r in read("region").collect()]
    texts = {
        "object": json.dumps({k: {"description": v} for k, v in own}),
        "array": json.dumps([{"table_id": k, "description": v} for k, v in own]),
        "lines": "\n".join(json.dumps({"id": k, "description": v}) for k, v in own),
        "near": json.dumps({f"table-{k}-x": {"description": f"region {v}"} for k, v in own}),
    }
    rows = []
    for form, text in texts.items():
        with open(f"{folder}/{form}.json", "w", encoding="utf-8") as f:
            f.write(text)
        found = load_metadata(f"{folder}/{form}.json")
        rows += [(form, k, dataset.metadata_of(found, k)["description"]) for k, _ in own]
    shutil.rmtree(folder)
    return spark.createDataFrame(rows, "form string, table_id string, description string")


@query("SELECT 0 AS line, '| n_nationkey | n_name | note |' AS text UNION ALL SELECT 1, '| --- | --- | --- |' UNION ALL SELECT 1 + row_number() OVER (ORDER BY n_nationkey), '| ' || n_nationkey || ' | ' || n_name || ' | ' || CASE WHEN n_nationkey % 2 = 0 THEN 'a\\|b c' ELSE '' END || ' |' FROM nation")
def markdown_out(spark, read):
    df = with_position(read("nation").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 2 == 0, "a|b\nc").alias("note")), ["n_nationkey"])
    return spark.createDataFrame(list(enumerate(to_markdown(df, rows=1000).splitlines())), "line long, text string")


@query(
    "SELECT '- ' || name || ' (' || kind || '): ' || vals AS line FROM (SELECT 'n_name' AS name, 'TEXT' AS kind, (SELECT string_agg(n_name, ', ' ORDER BY n_nationkey) FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 3)) AS vals"
    " UNION ALL SELECT 'n_regionkey', 'INTEGER', (SELECT string_agg(n_regionkey, ', ' ORDER BY k) FROM (SELECT n_regionkey, min(n_nationkey) AS k FROM nation GROUP BY 1 ORDER BY k LIMIT 3))"
    " UNION ALL SELECT 'half', 'REAL', (SELECT string_agg(n_nationkey / 2, ', ' ORDER BY n_nationkey) FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 3)))"
)
def column_descriptions(spark, read):
    """Names, types and the first three distinct values of columns, in the order of rows."""
    df = with_position(read("nation").withColumn("half", F.col("n_nationkey") / 2), ["n_nationkey"]).drop("n_nationkey")
    lines = qa.column_descriptions(df).splitlines()
    return spark.createDataFrame([(x,) for x in lines], "line string")


sql_query("sql_json", "events", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, array_size(json_object_keys(props)) AS n FROM events", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, len(json_keys(props))::INT AS n FROM events")


def _last_digit(x: pd.Series) -> pd.Series:
    return x % 10


@query("SELECT user_id % 10 AS g, event_type, count(*) AS n, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY 1, 2")
def sql_maps_and_functions(spark, read):
    """JSON as a map, a map built from rows, and a registered vectorised function, all in SQL."""
    spark.udf.register("last_digit", F.pandas_udf(_last_digit, "long"))
    qa.register(read("events"), "events")
    grouped = "SELECT last_digit(user_id) AS g, event_type, map('n', count(*), 'k', sum(from_json(props, 'map<string,bigint>')['k'])) AS m FROM events GROUP BY 1, 2"
    return spark.sql(qa.spark_sql(f"SELECT g, event_type, m['n'] AS n, m['k'] AS k FROM ({grouped}) x"))


@query("SELECT 'fenced' AS reply, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F')::VARCHAR AS answer UNION ALL SELECT 'bare', (SELECT max(o_custkey) FROM orders)::VARCHAR UNION ALL SELECT 'with', (SELECT count(*) FROM orders WHERE o_totalprice > 100000)::VARCHAR UNION ALL SELECT 'none', ''")
def sql_from_replies(spark, read):
    """Statements out of replies: in a fence, bare, with a common table expression, and none."""
    replies = {
        "fenced": "<reasoning>count SELECT not this</reasoning>\n```sql\nSELECT count(*) FROM orders WHERE \"o_orderstatus\" = 'F';\n```",
        "bare": "The answer: SELECT max(o_custkey) FROM orders\n\nas asked",
        "with": "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 100000) SELECT count(*) FROM big;",
        "none": "I cannot tell.",
    }
    o = read("orders")
    return spark.createDataFrame([(k, qa.answer(o, "orders", providers.extract_sql(r)[0])[0]) for k, r in replies.items()], "reply string, answer string")


@query("SELECT form, CASE form WHEN 'broken' THEN NULL ELSE (SELECT string_agg(r_name, ',' ORDER BY r_regionkey) FROM region) END AS names FROM (VALUES ('fenced'), ('single quotes'), ('no commas'), ('cut off'), ('broken')) t(form)")
def json_from_replies(spark, read):
    """Values out of replies that are nearly JSON."""
    own = [r.r_name for r in read("region").orderBy("r_regionkey").collect()]
    texts = {
        "fenced": "Here it is:\n```json\n" + json.dumps({"names": own}) + "\n```",
        "single quotes": "{'names': [" + ", ".join(f"'{x}'" for x in own) + ",]}",
        "no commas": '{"names": [' + " ".join(f'"{x}"' for x in own) + "]}",
        "cut off": json.dumps({"names": own})[:-2],
    }
    rows = [(k, ",".join(providers.read_json(t)["names"])) for k, t in texts.items()]
    try:
        rows.append(("broken", ",".join(providers.read_json("no value here"))))
    except ValueError:
        rows.append(("broken", None))
    return spark.createDataFrame(rows, "form string, names string")


@query(
    "SELECT r_regionkey::VARCHAR AS table_id, q.qid, CASE q.qid WHEN 'n' THEN count(n_nationkey)::VARCHAR WHEN 'first' THEN min(n_name) ELSE 'EMPTY' END AS predicted, q.qid <> 'none' AS exact, 'success' AS status"
    " FROM region JOIN nation ON n_regionkey = r_regionkey, (VALUES ('n'), ('first'), ('none')) q(qid) GROUP BY r_regionkey, q.qid"
)
def batch_of_tables(spark, read):
    """Question sets to answers: tables from markdown, plans and SQL from providers, artefacts in folders, read back from there."""
    from . import batch

    folder = tempfile.mkdtemp(prefix="batch-")
    by: dict[int, list] = {}
    for n in read("nation").orderBy("n_nationkey").collect():
        by.setdefault(n.n_regionkey, []).append(n)
    os.mkdir(f"{folder}/in")
    plan = {"steps": [{"step_id": "s", "op": "cast_column", "reads": ["key"], "writes": ["key"], "params": {"col": "key", "dtype": "integer"}}], "final_output": {"columns": []}}
    for k, own in by.items():
        table = "| key | name |\n|---|---|\n" + "\n".join(f"| {n.n_nationkey} | {n.n_name} |" for n in own)
        asked = [{"qid": "n", "text": f"n {k}", "answer": len(own)}, {"qid": "first", "text": f"first {k}", "answer": min(n.n_name for n in own)}, {"qid": "none", "text": f"none {k}", "answer": "x"}]
        with open(f"{folder}/in/{k}.json", "w", encoding="utf-8") as f:
            json.dump({"table_id": k, "markdown": table, "questions": asked}, f)

    class Plans:
        def plan(self, table_id, df, questions):
            return plan

    class Sql:
        def sql(self, table, df, question):
            kind = question.split()[0]
            return {"n": f"SELECT count(*) FROM {table}", "first": f"SELECT min(name) FROM {table}", "none": f"SELECT name FROM {table} WHERE key < 0"}[kind]

    total = batch.run(spark, f"{folder}/in", f"{folder}/out", Plans(), Sql(), tables=f"{scratch(spark)}/tables")
    status = {t["table_id"]: t["status"] for t in total["by_table"]}
    rows = []
    for k in status:
        with open(f"{folder}/out/{k}/qa_results.json", encoding="utf-8") as f:
            rows += [(k, r["qid"], r["predicted"], bool(r["correct"][0]), status[k]) for r in json.load(f)]
    shutil.rmtree(folder)
    return spark.createDataFrame(rows, "table_id string, qid string, predicted string, exact boolean, status string")
