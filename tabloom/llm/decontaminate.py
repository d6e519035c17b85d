"""Benchmark decontamination by suffix arrays over the training documents.

Each task cuts its documents into shards and builds the suffix array of each: all places of
words, sorted by the words that follow (to the length of a window), never across the end of
a document. It is built by doubling, from the sorted distinct words of the shard: ranks of
one word give ranks of two, four and eight, and two of eight that overlap sort the places by
13 words. The array knows nothing of the benchmark. Every benchmark suffix that begins a
window is then binary-searched in it, by the same ranks, and the range that is found holds
all verbatim occurrences in the shard. Words are compared as words, never by hashes.
Windows that follow each other on one diagonal give the longest match and its place, among
matches of at least one window (13 words, or a whole shorter item); shorter common runs are
not looked for.

The documents are not shuffled. The benchmark is sent in slices of at most ``slice_words``
words, longer items cut into pieces that overlap by a window less one word. A benchmark of
one slice takes one pass; a larger one takes a pass a slice, each written before the next
slice is read, so that no process holds more than one slice; the passes' hits are brought
together by the documents' SHA-256.

Which documents go: those with a verbatim match of a whole window of 13 words (or a longer
one), however small a part of them it is, and those that are ``contaminated`` by share.
The second part is there for items of fewer than 13 words: an item of one word occurs in
any text, so such items only count where they make up a twentieth of a document.

Edge cases: null and empty texts have no words, ``n_hit`` 0, and are not contaminated;
an item without words has no window; null item ids count as one item named by the empty
string, and repeated item rows as one item; repeated document rows are judged one by one;
an empty table of either kind gives no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

WINDOW = 13
#: Words of the benchmark that one broadcast holds at most.
SLICE_WORDS = 1_000_000
RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, longest_start long, longest_item string, affected boolean"
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _split(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the texts with A-Z folded."""
    return c.flat([_split(x) for x in texts.to_pylist()])


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the values from 1 on, and the distinct values in order."""
    order = np.argsort(key)
    x = key[order]
    new = np.r_[True, x[1:] != x[:-1]][: len(x)]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new)
    return rank, x[new]


class Shard:
    """The suffix array of some documents that follow each other."""

    def __init__(self, words: pa.Array, counts: np.ndarray):
        n = len(words)
        coded = words.dictionary_encode()
        by = pc.sort_indices(coded.dictionary).to_numpy()
        self.words = coded.dictionary.take(pa.array(by))
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(1, len(by) + 1)
        self.ends = np.cumsum(counts)
        self.base = n + 2
        self.left = np.repeat(self.ends, counts) - np.arange(n)  # words from a place to the end of its document
        self.ranks, self.known = {1: rank[coded.indices.to_numpy()]}, {}
        for k in (1, 2, 4):
            self.ranks[2 * k], self.known[2 * k] = _ranked(self.keys(k, k))
        key = self.keys(8, WINDOW - 8)
        self.order = np.argsort(key, kind="stable")
        self.sorted = key[self.order]

    def keys(self, k: int, step: int) -> np.ndarray:
        """What sorts the places by their first ``k + step`` words; a document's end sorts before any word."""
        r = self.ranks[k]
        after = np.zeros(len(r), np.int64)
        if len(r) > step:
            after[:-step] = r[step:]
        after[self.left <= step] = 0
        return r * self.base + after

    def find(self, size: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of the array whose suffixes begin with the sequences of ``size`` words of these keys."""
        if size == WINDOW:
            own = self.sorted
        else:
            k = 1 << (size.bit_length() - 1)
            # keys of a shorter prefix are in order along the array too
            own = (self.keys(k, size - k) if size > k else self.ranks[k])[self.order]
        return np.searchsorted(own, key, "left"), np.searchsorted(own, key, "right")


class Items:
    """A slice of the benchmark: (name, place of the first word in the item, words) of items or pieces of items."""

    def __init__(self, pieces: list[tuple[str, int, list[bytes]]]):
        counts = np.array([len(w) for _, _, w in pieces], np.int64)
        coded = pa.array([w for _, _, ws in pieces for w in ws], pa.large_binary()).dictionary_encode()
        self.words, self.codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        begin = np.cumsum(counts) - counts
        n = np.where(counts > WINDOW, counts - WINDOW + 1, np.minimum(counts, 1))
        owner = np.repeat(np.arange(len(pieces)), n)
        off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.at, self.size = begin[owner] + off, np.minimum(WINDOW, counts[owner])
        self.names = [x for x, _, _ in pieces]
        self.item, self.off = owner, off + np.array([p for _, p, _ in pieces], np.int64)[owner]

    def search(self, shard: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Occurrences in the shard: place, length, and which group of equal windows; the windows of each group."""
        place, size, group, groups = [], [], [], []
        number = pc.index_in(self.words, value_set=shard.words).fill_null(-1).to_numpy().astype(np.int64) + 1
        ranks = {1: number[self.codes]}
        n = len(self.codes)

        def keys(k: int, step: int, at: np.ndarray) -> np.ndarray:
            """Keys of the sequences of k + step words at these places; -1 where the shard lacks a part."""
            a, b = ranks[k][at], ranks[k][np.minimum(at + step, n - 1)]
            return np.where((a > 0) & (b > 0) & (at + step < n), a * shard.base + b, -1)

        every = np.arange(n)
        for k in (1, 2, 4):
            key = keys(k, k, every)
            known = shard.known[2 * k]
            at = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
            ranks[2 * k] = np.where((key >= 0) & (known[at] == key), at + 1, 0) if len(known) else np.zeros(n, np.int64)
        for s in np.unique(self.size).tolist():
            own = np.flatnonzero(self.size == s)
            k = 8 if s == WINDOW else 1 << (s.bit_length() - 1)
            key = keys(k, s - k, self.at[own]) if s > k else np.where(ranks[k][self.at[own]] > 0, ranks[k][self.at[own]], -1)
            own, key = own[key >= 0], key[key >= 0]
            by = np.argsort(key, kind="stable")
            heads = np.flatnonzero(np.r_[True, np.diff(key[by]) != 0])[: len(by)]
            low, high = shard.find(s, key[by][heads])
            for i in np.flatnonzero(high > low):
                found = shard.order[low[i] : high[i]]
                place.append(found)
                size.append(np.full(len(found), s))
                group.append(np.full(len(found), len(groups)))
                groups.append(own[by[heads[i] : heads[i + 1] if i + 1 < len(heads) else len(by)]])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *place]), np.concatenate([none, *size]), np.concatenate([none, *group]), groups


def hits(texts: pa.Array, items: Items) -> list[dict]:
    """For each text its number of words and the runs of windows that it shares with items: start, stop, item, and place in the item."""
    words, counts = words_of(texts)
    out = [{"n_words": int(n), "runs": []} for n in counts]
    if not len(words) or not len(items.at):
        return out
    shard = Shard(words, counts)
    p, size, group, groups = items.search(shard)
    doc = np.searchsorted(shard.ends, p, "right")
    order = np.lexsort((p, doc))
    p, size, group, doc = p[order], size[order], group[order], doc[order]
    edges = np.flatnonzero(np.r_[True, np.diff(doc) != 0, True]) if len(doc) else []
    for i, j in zip(edges[:-1], edges[1:]):
        x = p[i:j] - (shard.ends[doc[i]] - counts[doc[i]])
        lists = [groups[g] for g in group[i:j]]
        n = np.array([len(w) for w in lists])
        window = np.concatenate(lists)
        place, item, off = np.repeat(x, n), items.item[window], items.off[window]
        # windows of one item that follow each other on a diagonal are one longer match
        by = np.lexsort((place, place - off, item))
        place, item, off, length = place[by], item[by], off[by], np.repeat(size[i:j], n)[by]
        head = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (np.diff(place - off) != 0) | (np.diff(place) != 1)])
        stop = place[head] + length[head] + np.diff(np.r_[head, len(place)]) - 1
        out[doc[i]]["runs"] = [{"start": int(a), "stop": int(b), "item": items.names[k], "at": int(o)} for a, b, k, o in zip(place[head], stop, item[head], off[head])]
    return out


def verdict(n_words: int, runs: list[dict]) -> dict:
    """What is returned of a document, from the runs that it shares with items."""
    cover = np.zeros(n_words + 1, np.int64)
    np.add.at(cover, np.array([r["start"] for r in runs], np.int64), 1)
    np.add.at(cover, np.array([r["stop"] for r in runs], np.int64), -1)
    n, items = int((np.cumsum(cover[:-1]) > 0).sum()), sorted({r["item"] for r in runs})
    # runs of pieces of one item meet on their diagonal
    joined: list[list] = []
    for r in sorted(runs, key=lambda r: (r["item"], r["start"] - r["at"], r["start"])):
        last = joined[-1] if joined else None
        if last and last[0] == r["item"] and last[1] == r["start"] - r["at"] and r["start"] <= last[3] - WINDOW + 1:
            last[3] = max(last[3], r["stop"])
        else:
            joined.append([r["item"], r["start"] - r["at"], r["start"], r["stop"]])
    item, _, start, stop = min(joined, key=lambda x: (x[2] - x[3], x[2], x[0])) if joined else (None, 0, None, 0)
    longest, contaminated = stop - start if joined else 0, n > 0 and 20 * n >= n_words
    return {
        "n_words": n_words, "n_hit": n, "n_items": len(items), "items_sha256": hashlib.sha256(",".join(items).encode()).hexdigest(), "contaminated": contaminated,
        "longest": longest, "longest_start": start, "longest_item": item, "affected": longest >= WINDOW or contaminated,
    }


_TYPES = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(), "contaminated": pa.bool_(), "longest": pa.int64(), "longest_start": pa.int64(), "longest_item": pa.string(), "affected": pa.bool_()}
_RUN = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("item", pa.string()), ("at", pa.int64())])


def _slices(benchmark: DataFrame, item_col: str, text_col: str, slice_words: int) -> Iterator[Items]:
    """The benchmark in slices of bounded size, read one partition at a time."""
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text"))
    most = max(slice_words, 2 * WINDOW)
    held: list[tuple[str, int, list[bytes]]] = []
    n = 0
    for r in rows.toLocalIterator():
        words = _split(r.text)
        for at in range(0, max(1, len(words) - WINDOW + 1), most - WINDOW + 1):
            piece = words[at : at + most]
            if held and n + len(piece) > most:
                yield Items(held)
                held, n = [], 0
            held.append((r.item, at, piece))
            n += len(piece)
    yield Items(held)


def _one_pass(items, finish):
    """mapInArrow over rows whose last column is the text; the other columns go along."""

    def run(it):
        for b in c.gathered(it, -1):
            yield finish(b, hits(b.column(b.num_columns - 1), items.value))

    return run


def _annotated(docs: DataFrame, text_col: str, benchmark: DataFrame, item_col: str, bench_text_col: str, slice_words: int, carry: list[str], only_clean: bool) -> DataFrame:
    spark = c.prepare(docs.sparkSession)
    text, key, found = (c.fresh(docs, x) for x in ("__text", "__key", "__hits"))
    own = docs.select(*[F.col(f"`{x}`") for x in carry], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias(text))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    result = schema if only_clean else f"{schema}, {RESULT}"

    def finished(b, rows):
        if only_clean:
            return b.filter(pa.array([not r["affected"] for r in rows], pa.bool_()))
        return pa.record_batch([*b.columns, *(pa.array([r[k] for r in rows], t) for k, t in _TYPES.items())], [*b.schema.names, *_TYPES])

    slices = _slices(benchmark, item_col, bench_text_col, slice_words)
    first, second = next(slices), next(slices, None)
    if second is None:

        def finish(b, rows):
            return finished(pa.record_batch(b.columns[:-1], b.schema.names[:-1]), [verdict(**r) for r in rows])

        return own.mapInArrow(_one_pass(spark.sparkContext.broadcast(first), finish), result)

    def finish(b, rows):
        some = [i for i, r in enumerate(rows) if r["runs"]]
        return pa.record_batch([b.column(0).take(pa.array(some, pa.int64())), pa.array([rows[i]["runs"] for i in some], pa.list_(_RUN))], [key, "runs"])

    keyed = own.withColumn(key, F.unhex(F.sha2(text, 256)))
    passes = None
    while first is not None:
        sent = spark.sparkContext.broadcast(first)
        del first
        one = c.held(keyed.select(key, text).mapInArrow(_one_pass(sent, finish), f"`{key}` binary, runs array<struct<start: long, stop: long, item: string, at: long>>"))
        sent.destroy()
        passes = one if passes is None else passes.unionAll(one)
        first, second = second, next(slices, None)
    # equal texts have equal runs in each pass
    merged = passes.groupBy(key).agg(F.flatten(F.collect_set("runs")).alias(found))

    def close(it):
        for b in it:
            texts, runs = (b.column(len(carry) + i).to_pylist() for i in (0, 1))
            yield finished(pa.record_batch(b.columns[: len(carry)], carry), [verdict(len(_split(t)), r or []) for t, r in zip(texts, runs)])

    return keyed.join(merged, key, "left").select(*[F.col(f"`{x}`") for x in carry], text, found).mapInArrow(close, result)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", slice_words: int = SLICE_WORDS) -> DataFrame:
    """One row per document: its id, n_words, n_hit, n_items, items_sha256, contaminated (by share), the longest
    verbatim match (length in words, first word, item; null where none), and affected (whether it would be removed)."""
    return _annotated(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", benchmark, item_col, bench_text_col, slice_words, ["doc_id"], False)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", slice_words: int = SLICE_WORDS) -> DataFrame:
    """The documents without a verbatim match of a window of 13 words that no share of shorter items contaminates either, with all their columns."""
    return _annotated(docs, text_col, benchmark, item_col, bench_text_col, slice_words, docs.columns, True)
