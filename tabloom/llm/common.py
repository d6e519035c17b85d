"""Helpers the operators of this subpackage share: checkpoints, Arrow batches, word arrays."""

from __future__ import annotations

import ctypes
import gc
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..session import importable, local_folder

#: Documents handed to Python at a time, where the session has Spark's default: texts are long, and workers are many.
BATCH_ROWS = 1024
_ROWS, _DEFAULT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
#: Words a numpy chunk holds at most, besides those of its last document.
CHUNK_WORDS = 500_000
#: Bytes of text that are worked on at a time, besides those of the last document.
CHUNK_BYTES = 3 << 19
_LIBC = ctypes.CDLL(None)
U64 = np.uint64


def prepare(spark: SparkSession) -> SparkSession:
    """Give the session a checkpoint folder if it has none, and small Arrow batches if it has not chosen their size.

    ``spark.checkpoint.dir`` wins where it is set: it names the folder all executors
    share. A folder of our own is only for local tests.
    """
    if not spark.sparkContext.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise RuntimeError("spark.checkpoint.dir is not set on this cluster")
            named = local_folder("checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    importable(spark)
    if spark.conf.get(_ROWS) == _DEFAULT_ROWS:
        spark.conf.set(_ROWS, str(BATCH_ROWS))
    return spark


def held(df: DataFrame) -> DataFrame:
    """The DataFrame from checkpoint files, without its lineage."""
    return df.checkpoint()


def freed(spark: SparkSession) -> None:
    """After a large step: let the files go that only finished steps needed.

    Spark deletes shuffle files when the driver's JVM collects what refers to them, which a
    driver with little to do may put off for long; checkpoints go with the session's
    ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def deleted(spark: SparkSession, folder: str) -> None:
    """Delete a folder wherever Spark's file systems have it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the DataFrame does not have, whatever the case."""
    taken = {x.lower() for x in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ U64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U64(33))


def hashed_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, and the number of words of each.

    ``bytes.split()`` splits at just those characters. Null texts have no words.
    ``lower`` folds A-Z only, as ``bytes.lower()`` does. Words are held one text at a time.
    """
    parts = [hash_list((x.encode().lower() if lower else x.encode()).split() if x else []) for x in texts.to_pylist()]
    return np.concatenate([np.zeros(0, U64), *parts]), np.fromiter(map(len, parts), np.int64, len(parts))


def hash_list(words: list[bytes]) -> np.ndarray:
    """XXH3 of each word, 64 bits."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))


def flat(lists: list[list[bytes]]) -> tuple[pa.Array, np.ndarray]:
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return pa.array(list(itertools.chain.from_iterable(lists)), pa.large_binary()), counts


def word_hashes(words: pa.Array) -> np.ndarray:
    """XXH3 of each word, 64 bits; a word that occurs often is hashed once."""
    coded = words.dictionary_encode()
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), U64, len(coded.dictionary))
    return known[coded.indices.to_numpy()]


def sequence_hashes(h: np.ndarray, starts: np.ndarray | None, size: int, salt: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` words from each of ``starts`` on, or from every place (the last ones wrap).

    Each place of a sequence has a factor of its own, independent of the others, so
    sequences that agree as polynomials do not agree here.
    """
    factors = mix(np.arange(size, dtype=U64), salt) | U64(1)
    out = np.zeros(len(h) if starts is None else len(starts), U64)
    with np.errstate(over="ignore"):
        for i, f in enumerate(factors):
            out += (np.roll(h, -i) if starts is None else h[starts + i]) * f
    return mix(out, salt)


def trimmed() -> None:
    """Give memory that is free back to the system: a worker serves tasks of many stages and would keep the most that any took."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def batches(it: Iterable[pa.RecordBatch], text: int, most_chars: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most about ``most_chars`` bytes of text each (one document at least); memory is trimmed at the end."""
    yield from _slices(it, text, most_chars)
    trimmed()


def _slices(it: Iterable[pa.RecordBatch], text: int, most_chars: int) -> Iterator[pa.RecordBatch]:
    for b in it:
        if not b.num_rows:
            continue
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(text)), 0), dtype=np.int64))
        at = 0
        while at < b.num_rows:
            done = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, done + most_chars, "right")))
            yield b.slice(at, end - at)
            at = end


def gathered(it: Iterable[pa.RecordBatch], text: int, most_chars: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Like ``batches``, but small batches of one task are joined up to that size too."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in _slices(it, text, most_chars):
        n = b.column(text).nbytes
        if held and size + n > most_chars:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(b)
        size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held = []
    trimmed()
