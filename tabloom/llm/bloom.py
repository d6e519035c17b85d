"""A Bloom filter of 64-bit values that Spark tasks fill part by part.

Its size is bounded by ``most_bits`` (2^20 at the least) whatever the input. A filter that is too full lets
more values through; who uses it must hold that harmless.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as c

PARTS = 16


def _slots(bits: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (c.mix(x, 201) & c.U64(bits - 1)), (c.mix(x, 202) & c.U64(bits - 1))


def contains(table: bytes, x: np.ndarray) -> np.ndarray:
    """Which of the int64 or uint64 values may have been put in."""
    table, x = np.frombuffer(table, np.uint8), x.view(c.U64)
    ok = np.ones(len(x), bool)
    for at in _slots(8 * len(table), x):
        ok &= (table[at >> c.U64(3)] >> (at & c.U64(7)).astype(np.uint8)) & 1 == 1
    return ok


def build(values: DataFrame, most_bits: int = 1 << 30):
    """Broadcast the filter of a DataFrame's one long column (without nulls); 12 to 24 bits a value at first."""
    spark = values.sparkSession
    bits = 1 << max(20, min(int(12 * values.count()).bit_length(), most_bits.bit_length() - 1))

    def spread(it):
        for b in it:
            at = np.unique(np.concatenate(_slots(bits, b.column(0).to_numpy().view(c.U64))))
            part = (at * c.U64(PARTS) // c.U64(bits)).astype(np.int32)
            edges = np.searchsorted(part, np.arange(PARTS + 1))
            yield pa.record_batch([pa.array(np.arange(PARTS, dtype=np.int32)), pa.array([at[i:j].astype(np.uint32).tobytes() for i, j in zip(edges[:-1], edges[1:])])], ["part", "at"])

    def fill(table: pa.Table) -> pa.Table:
        k = table.column("part")[0].as_py()
        out = np.zeros(bits // PARTS // 8, np.uint8)
        for x in table.column("at").to_pylist():
            at = np.frombuffer(x, np.uint32).astype(np.int64) - k * (bits // PARTS)
            np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return pa.table({"part": [k], "bits": [out.tobytes()]}, schema=pa.schema([("part", pa.int32()), ("bits", pa.binary())]))

    got = {r.part: bytes(r.bits) for r in values.mapInArrow(spread, "part int, at binary").groupBy("part").applyInArrow(fill, "part int, bits binary").collect()}
    return spark.sparkContext.broadcast(b"".join(got.get(k, bytes(bits // PARTS // 8)) for k in range(PARTS)))
