"""CSV files: many words for a missing value, and types that the data decides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names
from ..functions import text as tx
from ..position import POS, q, with_position
from ..session import plan_bytes

#: Texts that mean a missing value.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


#: Bytes of input up to which files are read whole, so that cells may hold line breaks.
SPLIT_BYTES = 256 << 20


def read_csv(spark: SparkSession, path: str, infer: bool = True, positions: bool = True, whole_files: bool | None = None, **options) -> DataFrame:
    """A CSV file (or folder) with a header. Broken lines are dropped; columns get unique names.

    Cells may hold line breaks only if files are read whole, a task each (``whole_files``);
    otherwise Spark splits them. Unless that is told, files of up to ``SPLIT_BYTES`` in all
    are read whole and larger ones are not. All is read as text, missing words become null, and ``infer`` then gives columns
    of whole numbers, numbers or truth values their type, by one aggregate.
    """
    if whole_files is None:
        whole_files = plan_bytes(spark.read.text(path)) <= SPLIT_BYTES
    how = {"multiLine": whole_files, "escape": '"', "mode": "DROPMALFORMED", "inferSchema": False, **options}
    # Spark renames columns that differ in case only; the first line has their own names
    first = spark.read.options(**how).csv(path).first()
    df = spark.read.options(header=True, **how).csv(path)
    df = df.toDF(*names.unique([n or f"column_{i + 1}" for i, n in enumerate(first or df.columns)]))
    df = df.select(*[F.when(~q(c).isin(*MISSING), q(c)).alias(c) for c in df.columns])
    if infer:
        df = inferred(df)
    return with_position(df) if positions else df


def inferred(df: DataFrame) -> DataFrame:
    """Text columns whose values are all whole numbers, numbers or truth values, as such."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    cells = []
    for i, c in enumerate(texts):
        n = tx.number(q(c))
        cells += [F.count(q(c)).alias(f"v{i}"), F.count(n).alias(f"n{i}"), F.count_if(q(c).rlike(r"^\s*[+-]?\d{1,18}\s*$")).alias(f"i{i}"), F.count_if(q(c).isin("True", "False", "TRUE", "FALSE", "true", "false")).alias(f"b{i}")]
    r, made = df.agg(*cells).first(), {}
    for i, c in enumerate(texts):
        v = r[f"v{i}"]
        if v and r[f"i{i}"] == v:
            made[c] = F.trim(q(c)).cast("long")
        elif v and r[f"n{i}"] == v:
            made[c] = tx.number(q(c))
        elif v and r[f"b{i}"] == v:
            made[c] = F.lower(q(c)) == "true"
    return df.withColumns(made) if made else df


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """Rows in order, without positions. One header a file; ``bom`` marks a single small file as UTF-8 for spreadsheets."""
    if POS in df.columns:
        df = df.orderBy(POS).drop(POS)
    if not bom:
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
        return
    import csv

    with open(path, "w", newline="", encoding="utf-8-sig") as f:
        w = csv.writer(f)
        w.writerow(df.columns)
        w.writerows(df.toLocalIterator())
