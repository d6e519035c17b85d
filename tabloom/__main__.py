"""``python -m tabloom``: run a plan over a CSV file, ask it in SQL, flatten a table, check a plan, score answers, or run a question set."""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tabloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("run", help="a plan over a CSV file")
    a.add_argument("csv")
    a.add_argument("plan")
    a.add_argument("out", help="folder for final.parquet, execution_report.json, plan.json and step_pipeline.py")
    a.add_argument("--strict", action="store_true")
    a = sub.add_parser("ask", help="SQL over a CSV file or parquet folder")
    a.add_argument("data")
    a.add_argument("sql")
    a.add_argument("--table", default="t")
    a = sub.add_parser("flatten", help="a table with trees as headers to CSV")
    a.add_argument("json")
    a.add_argument("csv")
    a = sub.add_parser("validate", help="a plan's errors and warnings")
    a.add_argument("plan", nargs="?")
    a.add_argument("--schema", action="store_true", help="the operators and their parameters instead")
    a = sub.add_parser("score", help="exact match and F1 of answers")
    a.add_argument("results")
    a.add_argument("--gold")
    a = sub.add_parser("batch", help="a folder of question sets, with plans and SQL from files")
    a.add_argument("dataset")
    a.add_argument("out")
    a.add_argument("--plans", required=True, help="folder of <table_id>.json")
    a.add_argument("--sql", required=True, help="JSON object of SQL by question")
    a.add_argument("--workers", type=int, default=5)
    a.add_argument("--force", action="store_true")
    o = p.parse_args(argv)

    if o.command == "validate":
        from .plans import validate_plan
        from .plans.schema import prompt

        if o.schema or not o.plan:
            print(prompt())
            return 0
        with open(o.plan, encoding="utf-8") as f:
            v = validate_plan(json.load(f))
        print("\n".join([*(f"error: {e}" for e in v.errors), *(f"warning: {w}" for w in v.warnings)]) or "fine")
        return int(not v.ok)

    from .session import session

    spark = session()
    if o.command == "run":
        import os

        from .plans import Plan, execute, sanitize
        from .plans.emit import script
        from .sources import read_csv

        with open(o.plan, encoding="utf-8") as f:
            plan = json.load(f)
        df = read_csv(spark, o.csv)
        out, report = execute(df, plan, mode="strict" if o.strict else "lenient")
        os.makedirs(o.out, exist_ok=True)
        out.write.mode("overwrite").parquet(os.path.join(o.out, "final.parquet"))
        for name, text in (("execution_report.json", report.json()), ("plan.json", json.dumps(sanitize(Plan.of(plan), df).json(), indent=1)), ("step_pipeline.py", script(sanitize(Plan.of(plan), df), o.csv))):
            with open(os.path.join(o.out, name), "w", encoding="utf-8") as f:
                f.write(text)
        print(report.json())
        return int(report.completion < 1)
    if o.command == "ask":
        from .qa import answer
        from .sources import read_csv

        df = read_csv(spark, o.data) if o.data.endswith(".csv") else spark.read.parquet(o.data)
        text, error = answer(df, o.table, o.sql)
        print(error or text, file=sys.stderr if error else sys.stdout)
        return int(bool(error))
    if o.command == "flatten":
        from .sources import read_hierarchical, write_csv

        with open(o.json, encoding="utf-8") as f:
            write_csv(read_hierarchical(spark, f.read()), o.csv, bom=True)
        return 0
    if o.command == "score":
        from .batch import score_files

        print(json.dumps(score_files(spark, o.results, o.gold), indent=1))
        return 0
    from .batch import run
    from .providers import FilePlans, FixedSql

    with open(o.sql, encoding="utf-8") as f:
        total = run(spark, o.dataset, o.out, FilePlans(o.plans), FixedSql(json.load(f)), o.workers, o.force)
    print(json.dumps({k: v for k, v in total.items() if k != "by_table"}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
