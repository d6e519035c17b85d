"""Questions in SQL over a table, and answers as texts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import names
from .position import POS, q, with_position

NO_SQL = "No valid SQL"


def register(df: DataFrame, name: str) -> str:
    """The table as a view under a name that SQL takes."""
    view = names.table_name(name)
    df.drop(POS).createOrReplaceTempView(view)
    return view


def spark_sql(sql: str) -> str:
    """A statement as embedded engines take it, in Spark's words: ``"x"`` as a name, LIKE whatever the case, ``||`` as it is.

    Texts in single quotes stay. Whole-number division is Spark's ``div``; write that.
    """
    out = []
    for part in re.split(r"('(?:[^']|'')*')", sql):
        if not part.startswith("'"):
            part = re.sub(r'"((?:[^"]|"")*)"', lambda m: "`" + m[1].replace('""', '"').replace("`", "``") + "`", part)
            part = re.sub(r"\[([^\]\d][^\]]*)\]", r"`\1`", part)
            part = re.sub(r"\bLIKE\b", "ILIKE", part, flags=re.I)
            part = re.sub(r"\bIFNULL\s*\(", "coalesce(", part, flags=re.I)
            part = re.sub(r"\bGROUP_CONCAT\s*\(([^()]*)\)", lambda m: f"array_join(collect_list({m[1].split(',')[0].strip()}), ',')", part, flags=re.I)
        out.append(part)
    return "".join(out)


def shown(v) -> str:
    """A value as text: truth as 1 or 0, null as NULL."""
    return "NULL" if v is None else str(int(v)) if isinstance(v, bool) else str(v)


def formatted(rows: list[tuple]) -> str:
    """Rows as an answer: one value as it is, the values of a row joined by bars, at most ten rows joined by commas."""
    if not rows:
        return "EMPTY"
    return ", ".join(" | ".join(shown(v) for v in r) for r in rows[:10])


def answer(df: DataFrame, table: str, sql: str | None) -> tuple[str, str | None]:
    """(answer, error) of a statement over the table. Only as many rows as are shown leave the cluster."""
    if not sql or sql.strip().rstrip(";").upper() == "SELECT 1":
        return "", NO_SQL
    register(df, table)
    try:
        out = df.sparkSession.sql(spark_sql(sql.strip().rstrip(";")))
        return formatted([tuple(r) for r in out.limit(11).collect()]), None
    except Exception as e:
        return "", str(e).splitlines()[0]


def column_descriptions(df: DataFrame, samples: int = 3) -> str:
    """Name, type and first distinct values of each column."""
    lines = []
    df = with_position(df)
    for f in df.schema.fields:
        if f.name == POS:
            continue
        kind = "INTEGER" if isinstance(f.dataType, (T.IntegralType, T.BooleanType)) else "REAL" if isinstance(f.dataType, T.NumericType) else "TEXT"
        some = [r[0] for r in df.where(q(f.name).isNotNull()).groupBy(q(f.name)).agg(F.min(POS).alias("__first")).orderBy("__first").limit(samples).collect()]
        lines.append(f"- {f.name} ({kind}): {', '.join(map(str, some))}")
    return "\n".join(lines)


def prompt_material(df: DataFrame, table: str, rows: int = 50) -> dict[str, str]:
    """What whoever writes SQL needs to see."""
    from .sources.markdown import to_markdown

    return {"table": names.table_name(table), "columns": column_descriptions(df), "rows": to_markdown(df, rows)}


def answer_batch(df: DataFrame, table: str, questions: list[dict], provider, tries: int = 3) -> list[dict]:
    """Answers to questions (qid, text, ground_truth), with scores; an empty statement is asked for again."""
    from .functions.score import score_table

    asked = []
    for one in questions:
        sql = next((s for s in (provider.sql(names.table_name(table), df, one["text"]) for _ in range(tries)) if s), "")
        asked.append((one, sql, *answer(df, table, sql)))
    # all answers are scored in one job
    said = [(i, predicted, [str(t) for t in one["ground_truth"]]) for i, (one, _, predicted, _) in enumerate(asked)]
    scored = {r.i: [r.exact_match, r.f1] for r in score_table(df.sparkSession.createDataFrame(said, "i long, predicted string, targets array<string>")).select("i", "exact_match", "f1").collect()} if said else {}
    return [
        {"qid": one["qid"], "question": one["text"], "predicted": predicted, "targets": one["ground_truth"], "correct": scored[i], "sql": sql, "failure_reason": error or "", "reasoning": ""}
        for i, (one, sql, predicted, error) in enumerate(asked)
    ]


def summary(results: DataFrame) -> DataFrame:
    """Per table: questions, exact matches, their percentage, mean F1. ``results``: table_id, exact_match, f1."""
    return results.groupBy("table_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("exact_match").alias("exact"), F.round(100 * F.avg(F.col("exact_match").cast("int")), 1).alias("exact_percent"), F.round(F.avg("f1"), 4).alias("mean_f1"))
