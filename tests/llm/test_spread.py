"""Joins whose frequent keys are dealt over tasks."""

import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize("named", [100, 0])
def test_few_frequent_keys_need_no_python(spark, monkeypatch, named):
    from tabloom.llm import spread

    monkeypatch.setattr(spread, "HOT_ROWS", 5)
    monkeypatch.setattr(spread, "NAMED", named, raising=False)
    sizes = {1: 60, 2: 4, 3: 6, None: 7}
    many = spark.createDataFrame([(k, i) for k, n in [*sizes.items(), (4, 1)] for i in range(n)], "k long, i long")
    one = spark.createDataFrame([(k, f"x{k}", n) for k, n in sizes.items()], "k long, x string, n long")
    for how in ("inner", "left"):
        got = spread.join(many, one, ["k"], F.col("n"), F.col("i"), how)
        assert got.columns == ["k", "i", "x", "n"]
        assert sorted(map(str, got.collect())) == sorted(map(str, many.join(one, ["k"], how).collect()))
        assert ("MapInArrow" in got._jdf.queryExecution().executedPlan().toString()) == (named == 0)


def test_the_most_rows_of_a_key_are_seen_while_it_is_written(spark, monkeypatch):
    from tabloom.llm import spread

    monkeypatch.setattr(spread, "HOT_ROWS", 5)
    held, seen = spread.held(spark.createDataFrame([(1, 60), (2, 4)], "k long, n long"), F.col("n"))
    assert seen == (60, 1)
    many = spark.range(60).select(F.lit(1).cast("long").alias("k"), F.col("id").alias("i"))
    parts = spread.join(many, held, ["k"], F.col("n"), F.col("i"), "inner", seen)
    assert parts.count() == 60
    assert spread.held(held.where("n > 100"), F.col("n"))[1] == (0, 0)
