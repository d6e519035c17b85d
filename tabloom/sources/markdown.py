"""Markdown tables, single ones and whole corpora."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names
from ..position import POS
from ..session import importable

_RULE = re.compile(r"[\s|:-]+$")


def parse(content: str) -> tuple[list[str], list[list[str]]] | None:
    """Header and rows of a markdown table, or None if there is none.

    Lines that do not start with a bar go on with the cell above; those before the
    first bar are no part of the table. Rules between header and body are left out
    wherever they stand; outer bars are cut, and with them empty cells at the ends.
    Short rows are filled up with empty cells, long ones widen the table.
    """
    lines: list[str] = []
    for line in (x.strip() for x in content.strip().split("\n")):
        if line.startswith("|"):
            lines.append(line)
        elif line and lines:
            lines[-1] = f"{lines[-1].rstrip('|').rstrip()} {line}" + ("" if line.endswith("|") else " |")
    rows = [[c.strip() for c in x.strip("|").split("|")] for x in lines if not _RULE.match(x)]
    if len(rows) < 2:
        return None
    width = max(map(len, rows))
    header = names.header(rows[0] + [""] * (width - len(rows[0])))
    return header, [r + [""] * (width - len(r)) for r in rows[1:]]


def read_markdown(spark: SparkSession, content: str) -> DataFrame:
    """A markdown table as text columns with positions; empty cells are null."""
    got = parse(content)
    if got is None:
        raise ValueError("no markdown table")
    header, rows = got
    schema = T.StructType([T.StructField(h, T.StringType()) for h in header] + [T.StructField(POS, T.LongType())])
    return spark.createDataFrame([(*[c or None for c in r], i) for i, r in enumerate(rows)], schema)


CELLS = "table_id string, row int, col int, name string, value string"


def read_corpus(spark: SparkSession, path: str, table_id: str = "table_id", markdown: str = "markdown") -> DataFrame:
    """All tables of a folder of JSON files, cell by cell: each task parses its own files."""
    return explode_tables(spark.read.option("multiLine", True).json(path), table_id, markdown)


def explode_tables(tables: DataFrame, table_id: str = "table_id", markdown: str = "markdown") -> DataFrame:
    """Markdown tables in a column, cell by cell; texts without a table give no cells."""

    def run(it: Iterator) -> Iterator:
        import pandas as pd

        for pdf in it:
            out = []
            for t, content in zip(pdf["table_id"], pdf["markdown"]):
                got = parse(content or "")
                if got:
                    out += [(t, i, j, h, r[j] or None) for i, r in enumerate(got[1]) for j, h in enumerate(got[0])]
            yield pd.DataFrame(out, columns=["table_id", "row", "col", "name", "value"])

    importable(tables.sparkSession)
    return tables.select(F.col(table_id).cast("string").alias("table_id"), F.col(markdown).cast("string").alias("markdown")).mapInPandas(run, CELLS)


def to_markdown(df: DataFrame, rows: int = 50) -> str:
    """The first rows as a markdown table."""
    cols = [c for c in df.columns if c != POS]
    got = df.orderBy(POS).limit(rows).collect() if POS in df.columns else df.limit(rows).collect()

    def cell(x) -> str:
        return "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")

    lines = ["| " + " | ".join(cols) + " |", "|" + "|".join(" --- " for _ in cols) + "|"]
    return "\n".join(lines + ["| " + " | ".join(cell(r[c]) for c in cols) + " |" for r in got])
