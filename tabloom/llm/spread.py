"""Joins of many rows with one row a key, where some keys may have a large part of all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from . import bloom
from . import common as c

#: Rows of a key from which on they are dealt over several tasks, and how many times as many tasks each further level of ``STEP`` times the rows gets.
HOT_ROWS, STEP = 250, 8
#: So many frequent keys are sent as a table, which needs no Python; more are sent as Bloom filters.
NAMED = 1 << 14


def _measures(rows: Column) -> list[Column]:
    return [F.max(rows).alias("m"), F.count(F.when(rows > HOT_ROWS, 1)).alias("n")]


def held(one: DataFrame, rows: Column) -> tuple[DataFrame, tuple[int, int]]:
    """``one`` in files, and what ``join`` has to know of it: the most rows of a key and the number of frequent keys."""
    seen = Observation()
    out = c.held(one.observe(seen, *_measures(rows)))
    got = seen.get
    return out, (got.get("m") or 0, got.get("n") or 0)


def join(many: DataFrame, one: DataFrame, on: list[str], rows: Column, row: Column, how: str = "inner", seen: tuple[int, int] | None = None) -> DataFrame:
    """``many.join(one, on, how)``, where ``one`` has one row a key and comes out the same whenever it is computed.

    ``rows``: how many rows of ``many`` a row of ``one`` meets; ``row``: what tells the rows
    of ``many`` apart. The rows of frequent keys get a salt, and their row of ``one`` comes
    to each salt: 8 salts from ``HOT_ROWS`` rows on, 64 from eight times as many, and so on
    up to the number of partitions, so copies stay few against the rows they meet. Which
    keys are how frequent is sent as a table of up to ``NAMED`` keys, or else as a Bloom
    filter a level; a key that one takes for frequent in vain is salted on both sides alike.
    """
    most, frequent = seen or one.agg(*_measures(rows)).first()
    if (most or 0) <= HOT_ROWS:
        return many.join(one, on, how)
    parts = c.partitions(many.sparkSession)
    steps, limit, salts = [], HOT_ROWS, 1
    while limit < most and salts < parts:
        salts = min(STEP * salts, parts)
        steps.append((limit, salts))
        limit *= STEP
    if frequent <= NAMED:
        return _named(many, one, on, rows, row, how, steps)
    levels = [(bloom.build(one.where(rows > limit).select(F.xxhash64(*on).alias("h"))), salts) for limit, salts in steps]

    def salts_of(h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), np.int32)
        for sent, n in levels:
            out[bloom.contains(sent.value, h)] = n
        return out

    def salted(it):
        for b in it:
            salt = c.mix(b.column(1).to_numpy().view(c.U64)) % salts_of(b.column(0).to_numpy()).astype(c.U64)
            yield pa.record_batch([*b.columns[2:], pa.array(salt.astype(np.int32))], [*b.schema.names[2:], "salt_"])

    def counted(it):
        for b in it:
            yield pa.record_batch([*b.columns[1:], pa.array(salts_of(b.column(0).to_numpy()))], [*b.schema.names[1:], "salts_"])

    def schema(df: DataFrame, more: str) -> str:
        return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [more])

    left = many.select(F.xxhash64(*on).alias("h_"), F.xxhash64(row).alias("r_"), *many.columns).mapInArrow(salted, schema(many, "salt_ int"))
    right = one.select(F.xxhash64(*on).alias("h_"), *one.columns).mapInArrow(counted, schema(one, "salts_ int"))
    right = right.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.col("salts_") - 1))).drop("salts_")
    return left.join(right, [*on, "salt_"], how).drop("salt_")


def _named(many: DataFrame, one: DataFrame, on: list[str], rows: Column, row: Column, how: str, steps: list[tuple[int, int]]) -> DataFrame:
    """The same where the frequent keys are few: told by hashes of the keys, as Bloom filters do, without Python on the executors."""
    salts = F.lit(1)
    for limit, n in steps:
        salts = F.when(rows > limit, n).otherwise(salts)
    found: dict[int, int] = {}
    for r in one.where(rows > HOT_ROWS).select(F.xxhash64(*on).alias("h"), salts.alias("n")).collect():
        found[r.h] = max(r.n, found.get(r.h, 1))
    sent = pa.table({"h_": pa.array(list(found), pa.int64()), "salts_": pa.array(list(found.values()), pa.int32())})
    sent = F.broadcast(many.sparkSession.createDataFrame(sent, "h_ long, salts_ int"))
    salts = F.coalesce("salts_", F.lit(1))
    left = many.withColumn("h_", F.xxhash64(*on)).join(sent, "h_", "left").select(*many.columns, F.pmod(F.xxhash64(row, F.lit(1)), salts).cast("int").alias("salt_"))
    right = one.withColumn("h_", F.xxhash64(*on)).join(sent, "h_", "left").select(*one.columns, F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt_"))
    return left.join(right, [*on, "salt_"], how).drop("salt_")
