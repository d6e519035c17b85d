"""Text quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are pairs of neighbouring character classes, repeated neighbouring words
and repeated lines: what tells prose from shouting, symbol noise, tables and loops in any
language. Counts are weighted by tf-idf over all documents; a singular value decomposition
of the labelled sample gives the latent space. The labelled vectors (at most
``most_labelled`` of either label, some 60 numbers each) are broadcast; every document gets
the exact cosine to all of them, block by block, and the nearest ``neighbours`` vote, each
with its similarity as weight; all that are as near as the last of them vote too, so ties
and the order of rows decide nothing (similarities count to five decimals).

Terms of repetition are few among many pairs, so they get a weight. It is the one of
``REPEAT_WEIGHTS`` with the least squared error over five folds of the training sample;
labels of held-out documents have no part in it. Equal texts lie in one fold.

Edge cases: null and empty texts, and texts without similar neighbours, get the share of
label 1 in the sample (0.5 without labels); null ids are kept and are not held out;
repeated rows get equal scores; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from .labelled import held_out, training_rows

#: Labelled vectors of either label, dimensions of the latent space, neighbours that vote.
MOST_LABELLED, DIMENSIONS, NEIGHBOURS = 2000, 48, 15
CLASSES = 40
#: Bytes of text that are counted and compared at a time.
CHUNK_BYTES = 1 << 20
#: Weights that terms of repetition may get, and folds of the training sample that choose.
REPEAT_WEIGHTS, FOLDS = (1.0, 2.0, 4.0, 8.0), 5
TERMS = CLASSES * CLASSES + 4


def _classes() -> np.ndarray:
    """Character class of each byte: vowels and other letters by case, digits, white space, each punctuation mark, the rest."""
    out = np.zeros(256, np.int64)
    for b in range(256):
        ch = chr(b)
        if b >= 128:
            out[b] = 1
        elif ch.isalpha():
            out[b] = 2 + ch.isupper() + 2 * (ch.lower() in "aeiou")
        elif ch.isdigit():
            out[b] = 6
        elif ch == "\n":
            out[b] = 7
        elif ch.isspace():
            out[b] = 8
        elif ch.isprintable():
            out[b] = 9 + (sum(1 for x in range(33, b) if not chr(x).isalnum()) % (CLASSES - 9))
    return out


_CLASS = _classes()


def term_counts(texts: pa.Array) -> np.ndarray:
    """Counts of all terms in each text, one row a text."""
    rows = [(x or "").encode() for x in texts.to_pylist()]
    sizes = np.array([len(x) for x in rows], np.int64)
    code = _CLASS[np.frombuffer(b"".join(rows), np.uint8)]
    doc = np.repeat(np.arange(len(rows)), sizes)
    same = doc[1:] == doc[:-1]
    pair = doc[1:] * TERMS + code[:-1] * CLASSES + code[1:]
    out = np.bincount(pair[same], minlength=len(rows) * TERMS).reshape(-1, TERMS).astype(np.float32)
    for k, lists in enumerate(([x.split() for x in rows], [x.split(b"\n") for x in rows])):
        parts, n = c.flat(lists)
        h, own = c.word_hashes(parts), np.repeat(np.arange(len(rows)), n)
        again = (own[1:] == own[:-1]) & (h[1:] == h[:-1])
        if k:  # lines: equal to any earlier one of the text
            order = np.lexsort((h, own))
            again = (own[order][1:] == own[order][:-1]) & (h[order][1:] == h[order][:-1])
        seen = np.bincount(own[1:][again] if not k else own[order][1:][again], minlength=len(rows))
        out[:, CLASSES * CLASSES + 2 * k] = seen
        out[:, CLASSES * CLASSES + 2 * k + 1] = n - seen
    return out


class Space:
    """The latent space and the labelled vectors in it."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, weight: np.ndarray, dimensions: int, neighbours: int, repeat: float = 1.0):
        self.weight, self.neighbours, self.repeat = weight.astype(np.float32), neighbours, repeat
        self.weight[CLASSES * CLASSES :] *= repeat
        self.prior = float(labels.mean()) if len(labels) else 0.5
        x = self._weighted(counts)
        few = len(x) < x.shape[1]  # then the texts' own products have the same values, and are fewer
        value, vector = np.linalg.eigh((x @ x.T if few else x.T @ x).astype(np.float64))
        top = np.argsort(value)[::-1][:dimensions]
        top = top[value[top] > 1e-6]
        axes = x.T @ vector[:, top] / np.sqrt(value[top]) if few else vector[:, top]
        self.axes = np.ascontiguousarray(axes).astype(np.float32)
        self.labels = labels.astype(np.float32)
        self.vectors = self.project(counts)

    def _weighted(self, counts: np.ndarray) -> np.ndarray:
        x = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        x = np.log1p(1000 * x) * self.weight
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def project(self, counts: np.ndarray) -> np.ndarray:
        z = self._weighted(counts) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def votes(self, own: np.ndarray, vectors: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The share of label 1 among the nearest vectors, weighted by similarity; -1 where none is similar."""
        near = np.round(own @ vectors.T, 5)
        k = min(self.neighbours, near.shape[1])
        least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        w = np.where(near >= least[:, None], np.maximum(near, 0), 0).astype(np.float64)
        total = w.sum(axis=1)
        return np.where(total > 1e-6, (w @ labels.astype(np.float64)) / np.maximum(total, 1e-6), -1)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        out = self.votes(self.project(counts), self.vectors, self.labels)
        return np.clip(np.where((counts.sum(axis=1) > 0) & (out >= 0), out, self.prior), 0, 1)

    def error(self, fold: np.ndarray) -> float:
        """Mean squared error of the votes on the sample, each fold by the vectors of the others."""
        total = 0.0
        for f in np.unique(fold):
            own, others = fold == f, fold != f
            if others.any():
                v = self.votes(self.vectors[own], self.vectors[others], self.labels[others])
                total += float(((np.where(v >= 0, v, self.prior) - self.labels[own]) ** 2).sum())
        return total / max(len(fold), 1)


def fitted(counts: np.ndarray, labels: np.ndarray, weight: np.ndarray, dimensions: int, neighbours: int) -> Space:
    """The space with the weight of repetition that does best over folds of the sample, the least of equals."""
    fold = np.array([zlib.crc32(r.tobytes()) % FOLDS for r in counts], np.int64)
    spaces = [Space(counts, labels, weight, dimensions, neighbours, r) for r in (REPEAT_WEIGHTS if len(labels) else REPEAT_WEIGHTS[:1])]
    return min(spaces, key=lambda s: (round(s.error(fold), 6), s.repeat))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", most_labelled: int = MOST_LABELLED, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS) -> Space:
    c.prepare(docs.sparkSession)

    def frequency(it):
        n, df = 0, np.zeros(TERMS, np.int64)
        for b in c.batches(it, 0, CHUNK_BYTES):
            x = term_counts(b.column(0))
            n, df = n + len(x), df + (x > 0).sum(axis=0)
        yield pa.record_batch([pa.array([n]), pa.array([df.tobytes()], pa.binary())], ["n", "df"])

    def counted(it):
        for b in c.batches(it, 0, CHUNK_BYTES):
            yield pa.record_batch([b.column(1), pa.array([r.tobytes() for r in term_counts(b.column(0))], pa.binary())], ["label", "counts"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")

    def added(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.int64) for x in table.column("df").to_pylist()], axis=0)
        return pa.table({"k": [0], "n": [sum(table.column("n").to_pylist())], "df": [total.tobytes()]}, schema=pa.schema([("k", pa.int32()), ("n", pa.int64()), ("df", pa.binary())]))

    # partial sums meet in a few tasks before the driver sees them
    parts = docs.select(text).mapInArrow(frequency, "n long, df binary").withColumn("k", (F.spark_partition_id() % 16).cast("int")).groupBy("k").applyInArrow(added, "k int, n long, df binary").collect()
    n, df = sum(r.n for r in parts), np.sum([np.frombuffer(r.df, np.int64) for r in parts], axis=0) if parts else np.zeros(TERMS)
    rows = training_rows(docs, labels, label, most_labelled, id_col, text_col).select("text", "label").mapInArrow(counted, "label int, counts binary").collect()
    rows.sort(key=lambda r: (r.label, bytes(r.counts)))  # sums of floats depend on their order
    x = np.stack([np.frombuffer(r.counts, np.float32) for r in rows]) if rows else np.zeros((0, TERMS), np.float32)
    return fitted(x, np.array([r.label for r in rows], np.float32), np.log((1 + n) / (1 + df)) + 1, dimensions, neighbours)


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted of each document."""
    space = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, id_col, text_col, **options))
    own = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(it):
        for b in c.batches(it, 2, CHUNK_BYTES):
            s = space.value.scores(term_counts(b.column(2)))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(s.astype(np.float64)), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, held_out boolean, score double, predicted int")
