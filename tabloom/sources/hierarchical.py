"""Tables with trees as headers, above and at the left."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names
from ..position import POS
from ..session import importable


def paths(root: dict) -> dict[int, list[str]]:
    """The names on the way to each node with a line, the root's left out."""
    out: dict[int, list[str]] = {}
    stack: list[tuple[dict, list[str]]] = [(root, [])]
    while stack:
        node, above = stack.pop()
        here = [*above, str(node.get("name", ""))]
        if node.get("line_idx") is not None:
            out[int(node["line_idx"])] = here[1:]
        stack.extend((c, here) for c in reversed(node.get("children_dict") or []))
    return out


def flatten(table: dict) -> list[dict]:
    """A row for each line: ``row_level_0`` and on from the left tree, and a column for each path of the top tree.

    Lines and columns without a node have no levels or are left out; of two columns
    with one path the later one counts.
    """
    top, left = ({k: " / ".join(v) for k, v in paths(table["top_root"]).items()}, paths(table["left_root"]))
    out = []
    for i, line in enumerate(table.get("data") or []):
        row = {f"row_level_{k}": x for k, x in enumerate(left.get(i, ()))}
        row |= {top[j]: cell.get("value") for j, cell in enumerate(line) if j in top}
        out.append(row)
    return out


def read_hierarchical(spark: SparkSession, table: dict | str) -> DataFrame:
    """One such table as text columns with positions."""
    rows = flatten(json.loads(table) if isinstance(table, str) else table)
    keys = list(dict.fromkeys(k for r in rows for k in r))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names.unique(keys)] + [T.StructField(POS, T.LongType())])
    return spark.createDataFrame([(*[None if r.get(k) is None else str(r[k]) for k in keys], i) for i, r in enumerate(rows)], schema)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A folder of such tables, cell by cell (table_id is the file): each task flattens its own files."""
    return explode_tables(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("table_id"), F.col("value").alias("content")))


def explode_tables(tables: DataFrame, table_id: str = "table_id", content: str = "content") -> DataFrame:
    """Such tables as JSON in a column, cell by cell."""

    def run(it: Iterator) -> Iterator:
        import pandas as pd

        for pdf in it:
            out = [(t, i, k, None if v is None else str(v)) for t, content in zip(pdf["table_id"], pdf["content"]) for i, r in enumerate(flatten(json.loads(content))) for k, v in r.items()]
            yield pd.DataFrame(out, columns=["table_id", "row", "name", "value"])

    importable(tables.sparkSession)
    own = tables.select(F.col(table_id).cast("string").alias("table_id"), F.col(content).cast("string").alias("content"))
    return own.mapInPandas(run, "table_id string, row int, name string, value string")
