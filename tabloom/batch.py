"""Question sets from files to scored answers: ingest, plan, run, answer, score, summarise.

Tables are small and many, so they run side by side in threads of the driver over one
session, as Spark jobs in a fair pool. Whatever fails, a table still gets answers: without
a plan, or with one that fails, from the table as it came.
"""

from __future__ import annotations

import json
import os
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from . import qa
from .plans import Plan, execute, validate_plan
from .position import POS
from .providers import CodeProvider, PlanProvider, SqlProvider
from .sources import load_dataset, read_csv, read_markdown
from .sources.csv import inferred


def ingest(spark: SparkSession, entry: dict) -> DataFrame:
    """An entry's table, from its markdown or CSV file, with types."""
    if entry.get("markdown"):
        df = read_markdown(spark, entry["markdown"])
        return inferred(df)
    return read_csv(spark, entry["csv_path"])


def _dump(path: str, value) -> None:
    tmp = f"{path}.part"
    with open(tmp, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=1, ensure_ascii=False, default=str)
    os.replace(tmp, path)


def answered(folder: str) -> list[dict] | None:
    """The answers a folder holds, if all have SQL and less than half are empty."""
    path = os.path.join(folder, "qa_results.json")
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        rows = json.load(f)
    fine = rows and all(r.get("sql") for r in rows) and 2 * sum(r.get("predicted") in ("", "EMPTY") for r in rows) < len(rows)
    return rows if fine else None


def table_summary(rows: list[dict]) -> dict:
    exact = sum(bool(r["correct"][0]) for r in rows)
    return {"n": len(rows), "exact": exact, "exact_percent": round(100 * exact / len(rows), 1) if rows else 0.0, "mean_f1": round(sum(r["correct"][1] for r in rows) / len(rows), 4) if rows else 0.0}


def run_table(spark: SparkSession, entry: dict, folder: str, plans: PlanProvider, sql: SqlProvider, force: bool = False, code: CodeProvider | None = None, tables: str | None = None) -> dict:
    """One table: its artefacts in ``folder``, and status and summary.

    ``folder`` is the driver's; ``tables``: where Spark writes the final table, a folder that
    all executors see (needed on a cluster whose machines do not share ``folder``).
    """
    os.makedirs(folder, exist_ok=True)
    rows = None if force else answered(folder)
    status, report = "cached", None
    if rows is None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", entry["table_id"])
        raw = ingest(spark, entry)
        status, df = "no_plan", raw.drop(POS)
        plan = plans.plan(entry["table_id"], raw, entry["questions"])
        if plan is not None:
            checked = validate_plan(plan, raw.columns)
            if not checked.ok:  # once more, with what was wrong
                _dump(os.path.join(folder, "validation_errors.json"), checked.errors)
                plan = plans.plan(entry["table_id"], raw, [*entry["questions"], {"errors": checked.errors}])
                checked = validate_plan(plan, raw.columns) if plan is not None else checked
            if plan is not None and checked.ok:
                _dump(os.path.join(folder, "plan.json"), Plan.of(plan).json())
                try:
                    df, done = execute(raw, plan, code=code)
                    report, status = json.loads(done.json()), "success"
                    df.limit(1).collect()
                except Exception as e:  # the table as it came will do
                    df, status, report = raw.drop(POS), "transform_failed", {"error": str(e).splitlines()[0]}
            else:
                status = "invalid_plan"
        df = df.cache()
        df.write.mode("overwrite").parquet(f"{(tables or folder).rstrip('/')}/final")
        rows = qa.answer_batch(df, entry["table_id"], entry["questions"], sql)
        df.unpersist()
        _dump(os.path.join(folder, "questions.json"), entry["questions"])
        _dump(os.path.join(folder, "execution_report.json"), report)
        _dump(os.path.join(folder, "qa_results.json"), rows)
    summary = {"table_id": entry["table_id"], "status": status, **table_summary(rows)}
    _dump(os.path.join(folder, "qa_summary.json"), summary)
    return summary


def run(spark: SparkSession, dataset_dir: str, out_dir: str, plans: PlanProvider, sql: SqlProvider, workers: int = 5, force: bool = False, first: int = 0, last: int | None = None, code: CodeProvider | None = None, tables: str | None = None) -> dict:
    """All tables of a folder (or a slice of them): a folder each, and ``pipeline_summary.json``. ``tables``: as in run_table, for all of them."""
    entries = load_dataset(dataset_dir)[first:last]

    def one(entry: dict) -> dict:
        try:
            return run_table(spark, entry, os.path.join(out_dir, entry["table_id"]), plans, sql, force, code, tables and f"{tables.rstrip('/')}/{entry['table_id']}")
        except Exception as e:
            return {"table_id": entry["table_id"], "status": "failed", "error": str(e).splitlines()[0], "n": 0, "exact": 0, "mean_f1": 0.0}

    with ThreadPoolExecutor(max_workers=workers) as pool:
        done = list(pool.map(one, entries))
    n = sum(t["n"] for t in done)
    total = {"tables": len(done), "questions": n, "exact": sum(t["exact"] for t in done), "exact_percent": round(100 * sum(t["exact"] for t in done) / n, 1) if n else 0.0, "mean_f1": round(sum(t["mean_f1"] * t["n"] for t in done) / n, 4) if n else 0.0, "by_table": done}
    os.makedirs(out_dir, exist_ok=True)
    _dump(os.path.join(out_dir, "pipeline_summary.json"), total)
    return total


def score_files(spark: SparkSession, results: str, gold: str | None = None) -> dict:
    """The scores of a file of answers, against the targets in it or in a file of gold answers (id or qid, answer or answers)."""
    from .functions.score import score_table

    with open(results, encoding="utf-8") as f:
        rows = json.load(f)
    targets = {}
    if gold:
        with open(gold, encoding="utf-8") as f:
            for g in json.load(f):
                a = g.get("answers", g.get("answer", []))
                targets[str(g.get("qid", g.get("id")))] = [str(x) for x in (a if isinstance(a, list) else [a])]
    data = [(str(r["qid"]), str(r.get("predicted", "")), targets.get(str(r["qid"]), [str(t) for t in r.get("targets") or []])) for r in rows]
    df = score_table(spark.createDataFrame(data, "qid string, predicted string, targets array<string>"))
    scored = {r.qid: r for r in df.collect()}
    return {**table_summary([{"correct": [s.exact_match, s.f1]} for s in scored.values()]), "questions": [{"qid": k, "exact_match": s.exact_match, "f1": s.f1} for k, s in scored.items()]}
