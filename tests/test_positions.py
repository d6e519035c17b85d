"""Positions of large tables: a row has the same one each time it is asked for, and no window holds the table."""

import pytest
from pyspark.sql import functions as F

from tabloom.operators import apply
from tabloom.position import POS, filled, numbered, with_position


@pytest.fixture(scope="module")
def large(spark):
    """50,000 rows in no order; an explosion in its plan makes a table count as large. Partitions stay apart, as those of large tables do."""
    merged = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(0, 500, 1, 4).select(F.explode(F.sequence(F.lit(0), F.lit(99))).alias("i"), (F.col("id") * 7 % 500).alias("j"))
    k = F.col("i").cast("long") * 500 + F.col("j")
    yield df.select(k.alias("k"), F.lpad(k.cast("string"), 6, "0").alias("s"), F.when(k % 7 >= 3, k).alias("v"), F.repeat(F.lit("x"), F.col("j").cast("int")).alias("wide"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merged)


@pytest.mark.parametrize("keys", (["k"], ["s"], ["i", "k"]))
def test_fills_lose_and_mix_no_rows(large, keys):
    df = with_position(large.withColumn("i", F.col("k") % 3), keys)
    got = filled(df, {"v": F.col("v")}).select("k", "wide", "v").collect()
    order = sorted(range(50000), key=lambda k: (k % 3, k) if len(keys) > 1 else k)
    want, last = {}, None
    for k in order:
        last = want[k] = k if k % 7 >= 3 else last
    assert len(got) == 50000 and {r.k: r.v for r in got} == want


def test_numbers_after_a_sort(large):
    df = apply(with_position(large, ["k"]), "sort", by="s", ascending=False)
    got = numbered(df, "n").select("k", "wide", "n").collect()
    assert sorted((r.n, r.k) for r in got) == [(n + 1, 49999 - n) for n in range(50000)]


def test_keys_that_are_no_positions(spark, large):
    far = large.withColumn("k", F.col("k") * (1 << 40))
    for df, key in ((far, "k"), (large.withColumn("h", F.col("k") % 5), "h"), (large.withColumn("h", F.nullif("k", F.lit(7).cast("long"))), "h")):
        rows = with_position(df, [key]).select(POS, key).orderBy(POS).collect()
        values = [r[1] for r in rows]
        assert len({r[0] for r in rows}) == 50000 and values == sorted(values, key=lambda x: (x is None, x))


def test_eight_megabytes_are_not_ordered_by_one_window(spark):
    df = with_position(spark.range(1_000_000).withColumn("g", (F.col("id") % 1000).cast("string")), ["id"])
    for keep, first in (("first", 0), ("last", 999_000), (False, None)):
        out = apply(df, "deduplicate_rows", keys=["g"], keep=keep)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "SortAggregate" not in plan
        got = {r.g: r.id for r in out.collect()}
        assert got == ({} if first is None else {str(i): first + i for i in range(1000)})


def test_rows_stay_whole(spark):
    """Columns picked one by one, with nulls among them, come from the same row."""
    rows = [(1, None, 5.0, 3), (1, 7, None, 1), (1, 8, 2.0, 2), (2, None, None, 4)]
    df = spark.createDataFrame(rows, f"g long, a long, b double, {POS} long")
    for keep, want in (("first", {(1, 7, None), (2, None, None)}), ("last", {(1, None, 5.0), (2, None, None)}), (False, {(2, None, None)})):
        assert {tuple(r) for r in apply(df, "deduplicate_rows", keys=["g"], keep=keep).select("g", "a", "b").collect()} == want
