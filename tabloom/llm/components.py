"""Connected components of an edge list that no machine needs to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import common as c
from . import spread


def _held(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges in files, with their number and a sum of their hashes, observed while they are written."""
    seen = Observation()
    held = c.held(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
    got = seen.get
    return held, (got.get("n", 0), got.get("h"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of all ends of the edges (a, b): the least id that can be reached.

    Large-star and small-star rounds: each end is tied to the least of its neighbours until
    nothing changes, which takes a number of rounds that grows with the logarithm of the
    number of ends. Edges are rows in files throughout; each round is checkpointed. The
    edges of an end that has very many are dealt over tasks.
    """
    now, state = _held(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    for _ in range(rounds):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("edges")).select("u", F.least("u", "m").alias("m"), "edges")
        least, seen = spread.held(least, F.col("edges"))
        large = spread.join(both.where("v > u"), least, ["u"], F.col("edges"), F.col("v"), "inner", seen).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = c.held(large)
        least, seen = spread.held(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("edges")), F.col("edges"))
        small = spread.join(large, least, ["u"], F.col("edges"), F.col("v"), "inner", seen).drop("edges")
        now, after = _held(small.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"components still changed after {rounds} rounds")
    tied = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return tied.unionByName(tied.select(F.col("component").alias("id"), "component").distinct())
