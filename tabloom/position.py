"""Row order. Spark's rows have none, so a scan gives each row a position and ordered operators use it.

Positions are any ascending longs. Ordered work is done bucket by bucket (a bucket is a
range of 2**20 positions, so it is the same in every evaluation), and what one bucket
hands to the next (a count, a last value) is one row a bucket. No task ever sees the
whole table unless the table is small.

That work reads the table twice, so a row must get the same position each time. Spark cuts
a sorted table by a new sample whenever it sorts, so positions numbered after a sort are
kept in a cache (on disk); a key of whole numbers that hardly repeats is the position as it stands.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import plan_bytes

POS, _BUCKET = "__pos", "__bucket"
#: A table whose estimated size is below is ordered by one window. The estimate is of packed files: one task takes many times that.
SMALL_BYTES = 4 << 20
#: Keys that span more are not positions themselves, for they might fill a bucket each.
MOST_BUCKETS = 1 << 16


def q(name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def with_position(df: DataFrame, keys: Sequence[str] = (), small: int = SMALL_BYTES) -> DataFrame:
    """The table with positions: by the keys (nulls last), or in the order of the scan. ``small``: bytes below which one window does it."""
    if not keys:
        return df if POS in df.columns else df.withColumn(POS, F.monotonically_increasing_id())
    df = df.drop(POS)
    if plan_bytes(df) >= small and len(keys) == 1 and _serves(df, keys[0]):
        return df.withColumn(POS, q(keys[0]).cast("long"))
    return ordered(df, [q(k).asc_nulls_last() for k in keys], small)


def ordered(df: DataFrame, order: Sequence[Column], small: int = SMALL_BYTES) -> DataFrame:
    """The table sorted, with new positions; a large one goes to a cache, so that they stay what they are."""
    if plan_bytes(df) < small:
        new = df.withColumn("__new", F.row_number().over(Window.orderBy(*order)).cast("long"))
        return new.drop(POS).withColumnRenamed("__new", POS)
    return df.orderBy(*order).drop(POS).withColumn(POS, F.monotonically_increasing_id()).persist(StorageLevel.DISK_ONLY)


def _serves(df: DataFrame, key: str) -> bool:
    """Whether a key can be the position: whole numbers, none null, hardly any there twice, and not too far apart."""
    if not isinstance(df.schema[key].dataType, T.IntegralType):
        return False
    k = q(key).cast("long")
    span = F.shiftright(F.max(k), 20) - F.shiftright(F.min(k), 20)
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count(k).alias("own"), F.approx_count_distinct(k, 0.02).alias("distinct"), span.alias("span")).first()
    return 0 < r.n == r.own and r.distinct > 0.9 * r.n and r.span < MOST_BUCKETS


def positioned(df: DataFrame) -> tuple[DataFrame, bool]:
    """The table with positions, and whether they were there before."""
    return (df, True) if POS in df.columns else (with_position(df), False)


def _bucketed(df: DataFrame) -> DataFrame:
    return df.withColumn(_BUCKET, F.shiftright(POS, 20))


def numbered(df: DataFrame, out: str, start: int = 1, small: int = SMALL_BYTES) -> DataFrame:
    """Consecutive numbers in the order of positions. ``small``: bytes below which one window does it."""
    df, had = positioned(df)
    if plan_bytes(df) < small:
        df = df.withColumn(out, F.row_number().over(Window.orderBy(POS)).cast("long") + F.lit(start - 1))
        return df if had else df.drop(POS)
    df = _bucketed(df)
    before = df.groupBy(_BUCKET).agg(F.count(F.lit(1)).alias("__n"))
    before = before.select(_BUCKET, (F.sum("__n").over(Window.orderBy(_BUCKET)) - F.col("__n")).alias("__before"))
    df = df.join(before, _BUCKET)
    df = df.withColumn(out, F.col("__before") + F.row_number().over(Window.partitionBy(_BUCKET).orderBy(POS)) + F.lit(start - 1)).drop(_BUCKET, "__before")
    return df if had else df.drop(POS)


def filled(df: DataFrame, values: dict[str, Column], backward: bool = False, small: int = SMALL_BYTES) -> DataFrame:
    """Columns whose nulls take the last value before them (after them, if backward)."""
    df, had = positioned(df)
    order = F.col(POS).desc() if backward else F.col(POS).asc()
    if plan_bytes(df) < small:
        w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumns({k: F.last(v, ignorenulls=True).over(w) for k, v in values.items()})
        return df if had else df.drop(POS)
    df = _bucketed(df)
    own = [f"__v{i}" for i in range(len(values))]
    df = df.withColumns(dict(zip(own, values.values())))
    # the last value of each bucket, then of all buckets before it
    pick = F.min_by if backward else F.max_by
    last = df.groupBy(_BUCKET).agg(*[pick(F.col(o), F.when(F.col(o).isNotNull(), F.col(POS))).alias(o) for o in own])
    towards = F.col(_BUCKET).desc() if backward else F.col(_BUCKET).asc()
    w = Window.orderBy(towards).rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(_BUCKET, *[F.last(o, ignorenulls=True).over(w).alias(f"{o}c") for o in own])
    within = Window.partitionBy(_BUCKET).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.join(carried, _BUCKET)
    df = df.withColumns({k: F.coalesce(F.last(o, ignorenulls=True).over(within), F.col(f"{o}c")) for k, o in zip(values, own)})
    df = df.drop(_BUCKET, *own, *[f"{o}c" for o in own])
    return df if had else df.drop(POS)
