"""Removal of long repeated word sequences, found by recompression.

Every document is compressed in rounds: a first round names runs of one word, the later
rounds name pairs of neighbouring symbols, a left kind before a right kind. A name is a
64-bit hash of what it stands for, so one expansion has one name in all documents and
tasks, and no shared table of names is needed. Equal substrings get equal interior
symbols; only symbols near their ends may differ, for a neighbour outside may take them.

For each window of words the rounds give the symbols that are certain, whatever stands
around the window. The longest of them is the window's anchor; equal windows have equal
anchors at the same place. So two Spark rounds are enough: one counts anchors and finds
the shared ones, one brings the windows of shared anchors together and verifies them. What
is compared there is the anchor and a BLAKE2b digest of the window's very words, 64 bits
each, so no trick with words or their order makes different windows look equal.

Scale: both rounds aggregate within a chunk of a task first, so a passage that a third of
all documents hold is sent once a chunk. Anchors of more than ``HOT`` chunks are then
compared in two steps, first among a part of the chunks, and only what is left of each part
among all of them; no task gets a row a chunk of one anchor. Shared anchors come back to the
documents as a Bloom filter if it needs at most ``filter_bits`` bits, else by a join: each
document then gets the list of its own shared anchors. What either lets through in vain
changes no result. Only texts that lose words are shuffled, to meet the places of their windows.

Edge cases: null and empty texts have no words and lose none (SHA-256 of the empty text);
texts shorter than a window keep all words; a null ``doc_id`` is an id like another;
repeated rows count as occurrences of their windows; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from . import common as c

WINDOW, PAIR_ROUNDS, LONGEST = 35, 8, 16
#: Occurrences (two a chunk at most) of an anchor whose windows are compared in two steps.
HOT = 64
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _longest(length: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the longest symbol of lo..hi, the leftmost of equals."""
    best, size = lo.copy(), length[lo]
    for j in range(1, int((hi - lo).max(initial=0)) + 1):
        at = np.minimum(lo + j, hi)
        more = length[at] > size
        best[more], size[more] = at[more], length[at][more]
    return best


def anchors(h: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the name of the anchor of each and the anchor's first word.

    ``h``: hashes of the words of some documents, one after another; ``counts``: the
    number of words of each document.
    """
    n = len(h)
    ends = np.cumsum(counts)
    last = np.zeros(n, bool)
    last[ends[counts > 0] - 1] = True
    room = np.repeat(ends, counts) - np.arange(n)
    starts = np.flatnonzero(room >= window)
    name, first = np.zeros(len(starts), c.U64), np.zeros(len(starts), np.int64)
    sym, pos, length = h, np.arange(n), np.ones(n, np.int64)
    todo, lo, hi = np.arange(len(starts)), starts, starts + window - 1

    def settle(done: np.ndarray) -> None:
        if done.any():
            at = _longest(length, lo[done], hi[done])
            name[todo[done]], first[todo[done]] = sym[at], pos[at]

    for step in range(PAIR_ROUNDS + 1):
        if not len(todo):
            break
        if step == 0:
            heads = np.flatnonzero(np.r_[True, (sym[1:] != sym[:-1]) | last[:-1]])
            size = np.diff(np.r_[heads, n])
            run = np.repeat(np.arange(len(heads)), size)
            new_lo, new_hi = (heads + size)[run[lo]], heads[run[hi]] - 1
            short = size <= LONGEST
            keep = ~short[run]
            keep[heads] = True
            named = heads[short & (size > 1)]
            k = size[short & (size > 1)]
            put = c.mix(sym[named] ^ c.mix(k.astype(c.U64), 101), 102)
            many = k
        else:
            right = (c.mix(sym, step) >> c.U64(63)).astype(bool)
            free = length < LONGEST
            pair = ~right[:-1] & right[1:] & ~last[:-1] & (length[:-1] + length[1:] <= LONGEST)
            new_lo, new_hi = lo + (right[lo] & free[lo]), hi - (~right[hi] & free[hi])
            keep = np.r_[True, ~pair]
            named = np.flatnonzero(pair)
            with np.errstate(over="ignore"):
                put = c.mix(sym[named] * c.U64(0x9FB21C651E98DF25) + c.mix(sym[named + 1], 103), 104)
            many = None
        empty = new_lo > new_hi
        settle(empty)
        todo, new_lo, new_hi = todo[~empty], new_lo[~empty], new_hi[~empty]
        index = np.cumsum(keep) - 1
        if many is None:
            added = length[named + 1]
            sym, length = sym.copy(), length.copy()
            sym[named] = put
            length[named] += added
            over = last.copy()
            over[named] |= last[named + 1]
        else:
            sym, length, over = sym.copy(), length.copy(), last.copy()
            sym[named], length[named] = put, many
            over[named] = last[named + many - 1]
        sym, length, pos, last = sym[keep], length[keep], pos[keep], over[keep]
        lo, hi = index[new_lo], index[new_hi]
    settle(np.ones(len(todo), bool))
    return starts, name, first


def window_digests(words: pa.Array, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """BLAKE2b of the words of each window, 64 bits."""
    _, where, data = words.buffers()
    at = np.frombuffer(where, np.int64)[words.offset : words.offset + len(words) + 1]
    # the words with a space after each, so that their ends are told
    spaced = np.full(at[-1] - at[0] + len(words), 32, np.uint8)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if len(words) else np.zeros(0, np.uint8)
    spaced[np.arange(len(raw)) + np.repeat(np.arange(len(words)), np.diff(at))] = raw
    text, at = spaced.tobytes(), at - at[0] + np.arange(len(at))
    return np.frombuffer(b"".join([blake2b(text[i:j], digest_size=8).digest() for i, j in zip(at[starts].tolist(), at[starts + window].tolist())]), c.U64)


def _chunks(it, window, segment):
    """Batches with, of a segment each, the row, the place of its first word, the number of words; the words; and what ``anchors`` gives.

    A long document is several segments that overlap by a window less one word. Each window
    lies in one of them, and its anchor depends on nothing around it.
    """
    for b in c.gathered(it, 2, 6 * c.CHUNK_WORDS):
        rows: list[int] = []
        offsets: list[int] = []
        parts: list[list[bytes]] = []
        held = 0

        def chunk():
            words, counts = c.flat(parts)
            return b, np.array(rows), np.array(offsets), counts, words, *anchors(c.word_hashes(words), counts, window)

        for i, text in enumerate(b.column(2).to_pylist()):
            words = text.encode().split() if text else []
            for at in range(0, len(words) - window + 1, segment):
                part = words[at : at + segment + window - 1]
                if parts and held + len(part) > segment + window:
                    yield chunk()
                    rows, offsets, parts, held = [], [], [], 0
                rows.append(i)
                offsets.append(at)
                parts.append(part)
                held += len(part)
        if parts:
            yield chunk()


def _own_anchors(window, segment):
    """Each document's distinct anchors."""

    def run(it):
        for b, row, _, counts, _, starts, name, first in _chunks(it, window, segment):
            if len(name):
                new = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (name[1:] != name[:-1])])
                own = row[np.repeat(np.arange(len(counts)), counts)[starts[new]]]
                order = np.lexsort((name[new], own))
                a, o = name[new][order], own[order]
                one = np.r_[True, (a[1:] != a[:-1]) | (o[1:] != o[:-1])]
                at = pa.array(o[one])
                yield pa.record_batch([pa.array(a[one].view(np.int64)), b.column(0).take(at), b.column(1).take(at)], ["anchor", "id", "tag"])

    return run


def _pairs(row: np.ndarray, name: np.ndarray) -> np.ndarray:
    return c.mix(name ^ c.mix(row.astype(c.U64), 107), 108)


def _shared(b, bits, row: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Which anchors are shared, by the filter or by the lists of a fourth column."""
    if bits is not None:
        return bloom.contains(bits.value, name)
    lists = b.column(3)
    sizes = np.diff(lists.offsets.to_numpy())
    known = _pairs(np.repeat(np.arange(b.num_rows), sizes), lists.flatten().to_numpy().view(c.U64))
    return np.isin(_pairs(row, name), known)


def _anchor_rows(window, segment):
    def run(it):
        for *_, name, first in _chunks(it, window, segment):
            if len(name):
                new = np.r_[True, (first[1:] != first[:-1]) | (name[1:] != name[:-1])]
                one, n = np.unique(name[new], return_counts=True)
                yield pa.record_batch([pa.array(one.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], ["anchor", "n"])

    return run


def _ranges(starts: np.ndarray, *same: np.ndarray) -> np.ndarray:
    """Indices at which a range of consecutive starts with the same other values begins."""
    cut = np.r_[True, starts[1:] != starts[:-1] + 1]
    for x in same:
        cut[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(cut)


def _window_rows(window, segment, buckets, salts, bits, hot):
    def run(it):
        for b, row, offset, counts, words, starts, name, first in _chunks(it, window, segment):
            if not len(starts):
                continue
            doc = np.repeat(np.arange(len(counts)), counts)
            hit = _shared(b, bits, row[doc[starts]], name)
            starts, name, first = starts[hit], name[hit], first[hit]
            if not len(starts):
                continue
            whole = window_digests(words, starts, window)
            order = np.lexsort((whole, name))
            a, w = name[order], whole[order]
            heads = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (w[1:] != w[:-1])])
            size = np.diff(np.r_[heads, len(a)])
            many = np.empty(len(a), bool)
            many[order] = np.repeat(size > 1, size)
            send = ~many
            send[order[heads]] = True
            begin = np.cumsum(counts) - counts
            begin -= offset  # places are those in the document
            ids = b.column(0).to_numpy(zero_copy_only=False)[row]
            tags = b.column(1).to_numpy(zero_copy_only=False)[row]
            rows = []
            # windows that repeat within this chunk need no answer from the others
            p = starts[many]
            if len(p):
                d = doc[p]
                at = _ranges(p, d)
                d, p, n = d[at], p[at], np.diff(np.r_[at, len(p)])
                marks = np.stack([ids[d], tags[d], p - begin[d], n]).astype(np.int64)
                spread = (c.mix(tags[d].astype(np.int64).view(c.U64)) % c.U64(buckets)).astype(np.int64)
                rows += [(int(k), -1, 1, marks[:, spread == k].tobytes()) for k in np.unique(spread)]
            p, f, m, s, w = starts[send], first[send], many[send], name[send], whole[send]
            at = _ranges(p, f, s, m, doc[p])
            n = np.diff(np.r_[at, len(p)])
            d = doc[p[at]]
            fixed = np.stack([s[at].view(np.int64), m[at], ids[d], tags[d], p[at] - begin[d], n]).astype(np.int64)
            inside = [at, n, w]
            crowded = bloom.contains(hot.value, s[at])
            part = int(c.mix(tags[:1].astype(np.int64).view(c.U64) + c.U64(offset[0]), 106)[0] % c.U64(salts))
            for salt, own in ((-1, np.flatnonzero(~crowded)), (part, np.flatnonzero(crowded))):
                rows += [(k, salt, 0, x) for k, x in _packed(fixed, inside, own, buckets)]
            yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["bucket", "salt", "kind", "payload"])

    return run


def _packed(fixed: np.ndarray, inside, own: np.ndarray, buckets: int):
    """(bucket, payload) of ranges of windows: what each range has in common, and the digests of their windows."""
    at, n, w = inside
    bucket = (c.mix(fixed[0].view(c.U64), 9) % c.U64(buckets)).astype(np.int64)
    by = own[np.argsort(bucket[own], kind="stable")]
    edges = np.flatnonzero(np.r_[True, np.diff(bucket[by]) != 0, True]) if len(by) else []
    for i, j in zip(edges[:-1], edges[1:]):
        own = by[i:j]
        x = np.repeat(at[own], n[own]) + _inner(n[own])
        yield int(bucket[own[0]]), np.int64(len(own)).tobytes() + fixed[:, own].tobytes() + w[x].tobytes()


def _inner(n: np.ndarray) -> np.ndarray:
    """0..n0-1, 0..n1-1, ..."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _repeated(buckets: int, final: bool):
    """Of the windows of one bucket, the places of those that also start elsewhere; if others are still to be asked, what to ask them."""

    def run(table: pa.Table) -> pa.Table:
        fixed, digests, out, left = [], [], [], []
        ask = not final and table.column("salt")[0].as_py() >= 0
        for kind, payload in zip(table.column("kind").to_pylist(), table.column("payload").to_pylist()):
            if kind:
                out.append(np.frombuffer(payload, np.int64).reshape(4, -1))
                continue
            m = int(np.frombuffer(payload, np.int64, 1)[0])
            fixed.append(np.frombuffer(payload, np.int64, 6 * m, 8).reshape(6, m))
            digests.append(np.frombuffer(payload, c.U64, -1, 8 + 48 * m))
        if fixed:
            name, many, ids, tags, start, n = np.concatenate(fixed, axis=1)
            w = np.concatenate(digests)
            owner = np.repeat(np.arange(len(n)), n)
            a, m, p = name.view(c.U64)[owner], many[owner].astype(bool), start[owner] + _inner(n)
            order = np.lexsort((w, a))
            heads = np.flatnonzero(np.r_[True, (a[order][1:] != a[order][:-1]) | (w[order][1:] != w[order][:-1])])
            size = np.diff(np.r_[heads, len(order)])
            again = (size > 1) | np.logical_or.reduceat(m[order], heads)
            twice = np.empty(len(order), bool)
            twice[order] = np.repeat(again, size)
            found = np.flatnonzero(twice & ~m)  # the others have been marked where they stand
            if len(found):
                at = _ranges(p[found], owner[found])
                o = owner[found][at]
                out.append(np.stack([ids[o], tags[o], p[found][at], np.diff(np.r_[at, len(found)])]))
            if ask:  # one of each window; those that are answered already need no place
                one = np.sort(order[heads])
                at = _ranges(p[one], owner[one], twice[one])
                o = owner[one][at]
                rest = np.stack([name[o], twice[one][at], ids[o], tags[o], p[one][at], np.diff(np.r_[at, len(one)])]).astype(np.int64)
                left = list(_packed(rest, (at, rest[5], w[one]), np.arange(len(at)), buckets))
        x = np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64)
        none, many = pa.nulls(len(left), pa.int64()), x.shape[1]
        marks = [pa.chunked_array([pa.array(v), none]) for v in x]
        asked = [pa.chunked_array([pa.nulls(many, t), pa.array([r[i] for r in left], t)]) for i, t in ((0, pa.int32()), (1, pa.binary()))]
        kinds = [pa.chunked_array([pa.nulls(many, pa.int32()), pa.array([v] * len(left), pa.int32())]) for v in (-1, 0)]
        return pa.table([*marks, asked[0], *kinds, asked[1]], names=["id", "tag", "start", "n", "bucket", "salt", "kind", "payload"])

    return run


def _kept(window, known=None):
    """The answer of texts with the places of their repeated windows; with a filter, of those texts that it does not know, which have none."""

    def run(it):
        for b in c.gathered(it, 2):
            if known is not None:
                b = b.filter(pa.array(~bloom.contains(known.value, b.column(1).to_numpy())))
            n_words, gone, digests = [], [], []
            marks = [b.column(i).to_pylist() for i in (3, 4)] if known is None else [[None] * b.num_rows] * 2
            for text, at, n in zip(b.column(2).to_pylist(), *marks):
                words = text.encode().split() if text else []
                n_words.append(len(words))
                if at:
                    keep = np.zeros(len(words) + 1, np.int64)
                    np.add.at(keep, at, 1)
                    np.add.at(keep, np.array(at) + np.array(n) + window - 1, -1)
                    keep = np.cumsum(keep[:-1]) == 0
                    words = [words[i] for i in np.flatnonzero(keep)]
                gone.append(n_words[-1] - len(words))
                digests.append(b" ".join(words))
            yield pa.record_batch([b.column(0), pa.array(n_words, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in digests], pa.string()), pa.array([x.decode() for x in digests], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def _known(known):
    def run(it):
        for b in it:
            yield b.filter(pa.array(bloom.contains(known.value, b.column(2).to_numpy())))

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, filter_bits: int = 1 << 30, segment: int = c.CHUNK_WORDS, hot: int = HOT) -> DataFrame:
    """Each document without the words of windows that start more than once in the corpus.

    Returns doc_id, n_words, n_removed, kept_sha256 and kept_text (kept words joined by
    one space). ``segment``: words that are compressed at a time.
    """
    spark = c.prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    rows = own.select("id", "tag", "text")
    shared = c.held(rows.mapInArrow(_anchor_rows(window, segment), "anchor long, n int").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1"))
    crowded = bloom.build(shared.where(F.col("n") > hot).select("anchor"), filter_bits)
    shared = shared.select("anchor")
    parts = c.partitions(spark)
    if 8 * shared.count() <= filter_bits:
        bits = bloom.build(shared, filter_bits)
    else:
        bits = None
        lists = rows.mapInArrow(_own_anchors(window, segment), "anchor long, id long, tag long").join(shared, "anchor").groupBy("id", "tag").agg(F.collect_set("anchor").alias("shared"))
        rows = rows.join(lists, ["id", "tag"]).select("id", "tag", "text", "shared")
    asked = "bucket int, salt int, kind int, payload binary"
    answer = f"id long, tag long, start long, n long, {asked}"
    found = c.held(rows.mapInArrow(_window_rows(window, segment, 4 * parts, parts, bits, crowded), asked).groupBy("bucket", "salt").applyInArrow(_repeated(4 * parts, False), answer))
    rest = found.where("payload is not null").select("bucket", "salt", "kind", "payload").groupBy("bucket").applyInArrow(_repeated(4 * parts, True), answer)
    marks = found.where("payload is null").unionByName(rest).groupBy("id", "tag").agg(F.collect_list(F.struct("start", "n")).alias("marks"))
    marks = c.held(marks.select("id", "tag", F.col("marks.start").alias("start"), F.col("marks.n").alias("n")))
    known = bloom.build(marks.select("tag").distinct(), filter_bits)
    result = RESULT + ", kept_text string"
    whole = own.select("doc_id", "tag", "text").mapInArrow(_kept(window, known), result)
    some = own.mapInArrow(_known(known), own.schema).join(marks, ["id", "tag"], "left").select("doc_id", "tag", "text", "start", "n").mapInArrow(_kept(window), result)
    return whole.unionByName(some)
