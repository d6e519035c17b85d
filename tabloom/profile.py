"""What a table is like: statistics of its columns, years in them, and issues out of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .position import POS, q


def stats(df: DataFrame, samples: int = 5) -> list[dict]:
    """Type, number of distinct values, of nulls, and first values of each column: one aggregate and one short read."""
    own = [c for c in df.columns if c != POS]
    cells = [x for i, c in enumerate(own) for x in (F.count_distinct(q(c)).alias(f"u{i}"), F.count_if(q(c).isNull()).alias(f"m{i}"))]
    r = df.agg(*cells).first()
    return [{"column": c, "dtype": t, "n_unique": r[f"u{i}"], "n_missing": r[f"m{i}"], "samples": [x[0] for x in df.where(q(c).isNotNull()).select(q(c)).limit(samples).collect()]} for i, (c, t) in enumerate((c, dict(df.dtypes)[c]) for c in own)]


def stats_table(df: DataFrame) -> DataFrame:
    """The counts of ``stats`` as rows (column, n_unique, n_missing), lazily."""
    own = [c for c in df.columns if c != POS]
    one = df.agg(*[F.struct(F.lit(c).alias("column"), F.count_distinct(q(c)).alias("n_unique"), F.count_if(q(c).isNull()).alias("n_missing")).alias(f"c{i}") for i, c in enumerate(own)])
    return one.select(F.explode(F.array(*[f"c{i}" for i in range(len(own))])).alias("r")).select("r.*")


YEAR = r"\b(19|20)\d{2}\b"


def has_year(df: DataFrame, cols: list[str], share: float = 0.3) -> dict[str, bool]:
    """Whether so many of a column's values hold a year."""
    if not cols:
        return {}
    r = df.agg(*[F.avg(q(c).cast("string").rlike(YEAR).cast("int")).alias(f"a{i}") for i, c in enumerate(cols)]).first()
    return {c: (r[f"a{i}"] or 0) >= share for i, c in enumerate(cols)}


def issues(questions: DataFrame) -> DataFrame:
    """Questions (qid, depends_on, failure_reason) by reason: issue_id, description, cols, blocking_questions.

    Blank reasons make no issue; ids follow the order in which reasons first come up.
    """
    from .position import numbered, with_position

    own = with_position(questions).withColumn("description", F.trim("failure_reason")).where("description <> ''")
    cols = F.coalesce("depends_on", F.array().cast("array<string>"))
    out = own.groupBy("description").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(cols)))).alias("cols"), F.transform(F.array_sort(F.collect_list(F.struct(POS, "qid"))), lambda x: x["qid"]).alias("blocking_questions"), F.min(POS).alias(POS))
    out = numbered(out, "__n")
    return out.select(F.concat(F.lit("iss_"), F.lpad(F.col("__n").cast("string"), 3, "0")).alias("issue_id"), "description", "cols", "blocking_questions")
