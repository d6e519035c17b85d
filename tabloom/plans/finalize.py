"""The last projection of a plan, and tables any SQL engine takes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names
from ..functions import text as tx
from ..position import POS, numbered, q
from .model import Plan

ROW_IDS = ("row_id", "_row_id")


def project(df: DataFrame, plan: Plan, original: list[str]) -> DataFrame:
    """The plan's final columns: the order of its last select, else its output columns that are no snapshots.

    They hold if they are at least three and half as many as the table had; else every
    column stays whose name does not end in ``_raw``. The row id comes along, first.
    """
    s = plan.last_select
    wanted = list(s.params.get("cols") or []) if s else []
    wanted = wanted or [c.name for c in plan.columns if c.role != "raw_snapshot"]
    enough = len([c for c in wanted if c not in ROW_IDS]) >= max(3, len(original) // 2)
    if plan.columns and enough:
        if not set(ROW_IDS) & set(wanted):
            wanted = [c for c in ROW_IDS if c in df.columns][:1] + wanted
        kept = [c for c in wanted if c in df.columns]
    else:
        kept = [c for c in df.columns if not c.endswith("_raw") and c != POS]
    if not kept:
        return df
    return df.select(*[q(c) for c in dict.fromkeys(kept)], *[F.col(POS) for _ in [0] if POS in df.columns])


def sql_ready(df: DataFrame) -> DataFrame:
    """Plain names, no column without values, texts that are all numbers as numbers, and a row id that is unique.

    One aggregate over the data decides all of it. Positions go.
    """
    own = [c for c in df.columns if c != POS]
    new = dict(zip(own, names.sql_names(own)))
    df = df.select(*[q(c).alias(new[c]) for c in own], *[F.col(POS) for _ in [0] if POS in df.columns])
    own = list(new.values())
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    cells = [F.count(F.lit(1)).alias("n")] + [F.count(q(c)).alias(f"v{i}") for i, c in enumerate(own)]
    for i, c in enumerate(texts):
        x = tx.number(q(c))
        cells += [F.count(x).alias(f"x{i}"), F.max(x != F.floor(x)).alias(f"f{i}")]
    row_id = next((c for c in own if c.lower() == "row_id"), None)
    if row_id:
        cells.append(F.count_distinct(q(row_id)).alias("ids"))
    r = df.agg(*cells).first()
    if r["n"]:
        df = df.drop(*[c for i, c in enumerate(own) if not r[f"v{i}"]])
    made = {}
    for i, c in enumerate(texts):
        seen = r[f"v{own.index(c)}"]
        if seen and r[f"x{i}"] == seen:
            made[c] = tx.number(q(c)) if r[f"f{i}"] else tx.number(q(c)).cast("long")
    df = df.withColumns(made) if made else df
    if row_id and r["n"] and r["ids"] < r["n"]:
        columns = df.columns
        df = numbered(df.drop(row_id), row_id, start=0).select(*[q(c) for c in columns])
    return df.drop(POS)
