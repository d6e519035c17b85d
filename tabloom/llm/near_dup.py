"""Near-duplicate documents by HyperMinHash.

A document's set is its distinct five-word shingles. Its sketch has 256 buckets; a bucket
keeps of its smallest hash the number of leading zeros (6 bits) and the ten bits after the
first one. Bands of six registers give the candidates, the collision-corrected estimate of
the Jaccard similarity drops the hopeless ones, and the full sets decide.

Equal sets are one class, and only classes are compared. Classes that share a band's
bucket are candidates if their sizes allow the similarity and if their signatures (the low
bits of all registers, 32 bytes) do not differ too much; the registers' estimate and then
the full sets decide. Within small buckets that is done pair by pair. In a large bucket
all classes are first compared with one hub, the class that has most company over all its
buckets; what the hub links is one component already. What is left of large buckets is
compared cell by cell (classes of like size, in blocks). A cell with many likely pairs
gives no pairs but its members: their sets are compared block by block by exact counts of
common shingles, each pair of blocks once however many buckets it shares, and only the
links of a spanning forest leave a block. So a large group of copies costs about one
comparison a copy, and a large group of unlinked relatives costs arithmetic but no rows.

Two documents at the threshold share no band with probability 2.3e-9; the limits on
signature and estimate lie five standard deviations beyond what linked sets show. Small
sets leave most buckets empty; bands of empty buckets are not used, and for such sets the
sketch is nearly the set.

Edge cases: null and empty texts have the empty set and stay alone; texts of fewer than
five words have one shingle, the whole; rows of one ``doc_id`` with different texts are
judged each by its own text; rows without ``doc_id`` are linked like all others, take the
least doc_id of their component and go, or, where no row of it has one, have none and are
all kept; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bloom, spread
from . import common as c
from .components import components

SHINGLE, BUCKETS, ROWS = 5, 256, 6
BANDS = BUCKETS // ROWS
MANTISSA, VALUE_BITS, EMPTY = 10, 52, 0xFFFF
#: The rule of linking, 100 * intersection >= PERCENT * union, and the least estimate that is verified.
PERCENT, LEAST_ESTIMATE = 85, 0.7
#: Members of a bucket whose pairs are listed; larger ones are compared in blocks of so many classes and elements.
SMALL, BLOCK, BLOCK_ELEMENTS = 48, 512, 300_000
#: Likely pairs a member that a cell lists; with more its members' sets are compared.
DENSE = 4
#: Groups of more rows give memory back when they are done.
TRIM_ROWS = 256


def shingles(h: np.ndarray, counts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of documents that follow each other, sorted within each, and the number of each."""
    n, ends = len(h), np.cumsum(counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    whole = np.arange(n) + size <= ends[doc]
    x, own = c.sequence_hashes(h, None, size, 21)[whole], doc[whole]
    for k in range(1, size):  # short texts: the whole sequence
        few = np.flatnonzero(counts == k)
        if len(few):
            x, own = np.r_[x, c.sequence_hashes(h, ends[few] - k, k, 40 + k)], np.r_[own, few]
    order = np.argsort(x)
    order = order[np.argsort(own[order].astype(np.uint16 if len(counts) < 1 << 16 else np.int64), kind="stable")]
    x, own = x[order], own[order]
    new = np.r_[True, (x[1:] != x[:-1]) | (own[1:] != own[:-1])][: len(x)]
    return x[new], np.bincount(own[new], minlength=len(counts))


def registers(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sketch of each set, one row of 16-bit registers."""
    v = c.mix(x, 23)
    doc = np.repeat(np.arange(len(counts)), counts)
    least = np.full(len(counts) * BUCKETS, 1 << VALUE_BITS, np.int64)
    np.minimum.at(least, doc * BUCKETS + (v & c.U64(BUCKETS - 1)).astype(np.int64), (v >> c.U64(64 - VALUE_BITS)).astype(np.int64))
    empty = least == 1 << VALUE_BITS
    zeros = VALUE_BITS - np.frexp(np.where(empty, 0, least).astype(np.float64))[1]
    rest = ((least << np.minimum(zeros, VALUE_BITS)) >> (VALUE_BITS - 1 - MANTISSA)) & ((1 << MANTISSA) - 1)
    out = np.where(empty, EMPTY, (zeros << MANTISSA) | rest).astype(np.uint16)
    return out.reshape(-1, BUCKETS)


def band_keys(regs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all bands that are not empty."""
    part = regs[:, : BANDS * ROWS].reshape(len(regs), BANDS, ROWS).astype(c.U64)
    key = np.broadcast_to(c.mix(np.arange(BANDS, dtype=c.U64), 24), part.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for i in range(ROWS):
            key = c.mix(key * c.U64(0x9E3779B97F4A7C15) + part[:, :, i], 25)
    row, band = np.nonzero((part != EMPTY).any(axis=2))
    return row, key[row, band]


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The Jaccard similarity by the registers of pairs, less what equal registers owe to chance."""
    used = (a != EMPTY) | (b != EMPTY)
    same = (a == b) & used
    bit = np.arange(VALUE_BITS)

    def zeros(k):  # chance that a bucket's least hash has so many leading zeros
        rate = np.asarray(k, float)[:, None] / BUCKETS
        return np.exp(-rate * 2.0 ** -(bit + 1)) - np.exp(-rate * 2.0**-bit)

    chance = (zeros(n) * zeros(m)).sum(axis=1) / (1 << MANTISSA)
    share = same.sum(axis=1) / np.maximum(used.sum(axis=1), 1)
    return (share - chance) / (1 - chance)


def _sketches(percent_size):
    def run(it):
        for b in c.gathered(it, 1):
            x, n = shingles(*c.hashed_words(b.column(1), lower=True), percent_size)
            regs = registers(x, n)
            sums = []
            for salt in (31, 32):
                total = np.r_[c.U64(0), np.cumsum(c.mix(x, salt), dtype=c.U64)]
                ends = np.cumsum(n)
                sums.append((total[ends] - total[ends - n]).view(np.int64))
            yield pa.record_batch([b.column(0), b.column(2), pa.array(n.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), pa.array([r.tobytes() for r in regs], pa.binary())], ["id", "key", "n", "s1", "s2", "regs"])

    return run


def _bands(known=None):
    """The bands of all sketches; with a filter, of those that it knows."""

    def run(it):
        for b in it:
            if b.num_rows:
                row, key = band_keys(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, BUCKETS))
                if known is not None:
                    some = bloom.contains(known.value, key)
                    row, key = row[some], key[some]
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(b.column(0).to_numpy()[row])], ["key", "id"])
        c.trimmed()

    return run


def signatures(regs: np.ndarray) -> np.ndarray:
    """The low bit of each register, 0 for an empty one, packed."""
    return np.packbits((regs & 1).astype(bool) & (regs != EMPTY), axis=1)


def _signed(it):
    for b in it:
        if b.num_rows:
            sig = signatures(np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint16).reshape(-1, BUCKETS))
            yield pa.record_batch([b.column(0), b.column(1), pa.array([x.tobytes() for x in sig], pa.binary())], ["id", "n", "sig"])
    c.trimmed()


def _most_differing(n: np.ndarray, percent: int) -> np.ndarray:
    """Signature bits in which a set of size n and one it is linked with differ at most (by five standard deviations)."""
    used = BUCKETS * -np.expm1(-n / BUCKETS)
    p = (100 - percent) / 200
    return used * p + 5 * np.sqrt(used * p * (1 - p)) + 3


def _sets(size, ids=None):
    """Registers and sets of texts; with a filter, of those that it knows."""

    def known(it):
        for b in it:
            yield b if ids is None else b.filter(pa.array(bloom.contains(ids.value, b.column(0).to_numpy())))

    def run(it):
        for s in c.batches(known(it), 1):
            x, n = shingles(*c.hashed_words(s.column(1), lower=True), size)
            ends = np.cumsum(n)
            yield pa.record_batch([s.column(0), pa.array([r.tobytes() for r in registers(x, n)], pa.binary()), pa.array(n.astype(np.int64)), pa.array([x[e - k : e].tobytes() for e, k in zip(ends, n)], pa.binary())], ["id", "regs", "n", "elements"])

    return run


def _verified(percent, least):
    """Of pairs with their registers, sizes and sets: those whose estimate will do and whose sets then are linked."""

    def run(it):
        for b in it:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint16).reshape(-1, BUCKETS) for k in ("ra", "rb"))
            ok = estimate(x, y, b.column("na").to_numpy(), b.column("nb").to_numpy()) >= least
            b, ok, last, y = b.select(["a", "b", "xa", "xb"]).filter(pa.array(ok)), [], None, None
            for one, two, mine, other in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                if two != last:
                    last, y = two, np.frombuffer(other.as_buffer(), c.U64)
                x = np.frombuffer(mine.as_buffer(), c.U64)
                both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                ok.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            yield pa.record_batch(b.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))
        c.trimmed()

    return run


def _trimming(run):
    """The function of a group, which gives back what a large group took."""

    def trimming(table: pa.Table) -> pa.Table:
        out = run(table)
        if table.num_rows > TRIM_ROWS:
            c.trimmed()
        return out

    return trimming


def _small_pairs(percent):
    """Likely pairs of classes of each (small) bucket of a group of buckets."""

    def run(table: pa.Table) -> pa.Table:
        key, ids, n = (table.column(x).to_numpy() for x in ("key", "id", "n"))
        order = np.lexsort((ids, key))
        key, ids, n = key[order], ids[order], n[order]
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), c.U64).reshape(len(ids), -1)[order]
        most = _most_differing(n, percent)
        out = [np.zeros((2, 0), np.int64)]
        for k in range(1, SMALL):
            x = np.flatnonzero(key[k:] == key[:-k])
            if not len(x):
                break
            x = x[100 * np.minimum(n[x], n[x + k]) >= percent * np.maximum(n[x], n[x + k])]
            x = x[np.bitwise_count(sig[x] ^ sig[x + k]).sum(axis=1) <= np.maximum(most[x], most[x + k])]
            out.append(np.stack([ids[x], ids[x + k]]))
        a = np.unique(np.concatenate(out, axis=1), axis=1)
        return pa.table([pa.array(a[0]), pa.array(a[1])], names=["a", "b"])

    return run


def _cell_pairs(percent):
    """Likely pairs of two cells of a large bucket (or of one); of a dense one, its members with the bucket."""

    def run(table: pa.Table) -> pa.Table:
        ids, comp, n, high = (table.column(x).to_numpy() for x in ("id", "component", "n", "high"))
        none = np.zeros(0, np.int64)
        a, b, own = none, none, none
        if (comp != comp[0]).any():
            n = n.astype(np.float32)
            bits = np.unpackbits(np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1), axis=1).astype(np.float32)
            one, two = (np.flatnonzero(~high), np.flatnonzero(high)) if high.any() else (np.arange(len(ids)),) * 2
            ones = bits.sum(axis=1)
            differ = ones[one][:, None] + ones[two][None, :] - 2 * (bits[one] @ bits[two].T)
            most = _most_differing(n, percent).astype(np.float32)
            ok = differ <= np.maximum(most[one][:, None], most[two][None, :])
            ok &= np.float32(100) * np.minimum(n[one][:, None], n[two][None, :]) >= percent * np.maximum(n[one][:, None], n[two][None, :])
            ok &= comp[one][:, None] != comp[two][None, :]
            if not high.any():
                ok = np.triu(ok, 1)
            x, y = np.nonzero(ok)
            if len(x) > DENSE * len(ids):
                own = np.unique(np.r_[one[x], two[y]])
            else:
                a, b = np.minimum(ids[one[x]], ids[two[y]]), np.maximum(ids[one[x]], ids[two[y]])
        rows = pa.array(own)
        blank = pa.nulls(len(a), pa.int64())
        return pa.table(
            [pa.array(np.r_[a, ids[own]]), pa.chunked_array([pa.array(b), pa.nulls(len(own), pa.int64())])] + [pa.chunked_array([blank, table.column(x).combine_chunks().take(rows)]) for x in ("key", "component", "crowd", "hub", "n")],
            names=["a", "b", "key", "component", "crowd", "hub", "n"],
        )

    return run


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """The number of common elements of each two sets."""
    n = len(sets)
    x, row = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(x, kind="stable")
    x, row = x[order], row[order]
    heads = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    size = np.diff(np.r_[heads, len(x)])
    rare = np.repeat(size <= 16, size)
    out = np.zeros((n, n), np.float32)
    y, r = x[rare], row[rare]  # elements of few sets: their pairs are counted one by one
    for k in range(1, 16):
        same = np.flatnonzero(y[k:] == y[:-k])
        if not len(same):
            break
        out += np.bincount(r[same] * n + r[same + k], minlength=n * n).reshape(n, n)
    out += out.T
    column = np.repeat(np.cumsum(size > 16) - 1, size)[~rare]  # the others by products of 0-1 matrices
    r = row[~rare]
    for lo in range(0, int((size > 16).sum()), 2048):
        here = (column >= lo) & (column < lo + 2048)
        m = np.zeros((n, 2048), np.float32)
        m[r[here], column[here] - lo] = 1
        out += m @ m.T
    return out


def _block_links(percent):
    """A spanning forest of the links between classes of two blocks (or of one)."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("id").to_numpy())
        ids, comp = table.column("id").to_numpy()[order], table.column("component").to_numpy()[order]
        elements = table.column("elements").to_pylist()
        sets = [np.frombuffer(elements[i], c.U64) for i in order]
        n = np.array([len(s) for s in sets], np.float32)
        both = common_counts(sets)
        linked = (100 * both >= percent * (n[:, None] + n[None, :] - both)) & (comp[:, None] != comp[None, :])
        up = {int(x): int(x) for x in comp}

        def find(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        out = []
        for i, j in np.argwhere(np.triu(linked, 1)):
            x, y = find(int(comp[i])), find(int(comp[j]))
            if x != y:
                up[max(x, y)] = min(x, y)
                out.append((ids[i], ids[j]))
        a = np.array(out, np.int64).reshape(-1, 2)
        return pa.table([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])

    return run


def _key(text_col: str):
    """What tells texts of one doc_id apart, and names a class: a 64-bit hash of the text."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, size: int = SHINGLE, least: float = LEAST_ESTIMATE, filter_bits: int = 1 << 30) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets;
    component_id is the least doc_id of those that links reach. ``filter_bits``: how large the
    filter of classes whose sets are needed may be; where that is too small they are joined.
    """
    return _linked(docs, id_col, text_col, percent, size, least, filter_bits).drop("key")


def _linked(docs: DataFrame, id_col: str, text_col: str, percent: int = PERCENT, size: int = SHINGLE, least: float = LEAST_ESTIMATE, filter_bits: int = 1 << 30) -> DataFrame:
    """The columns of link_components and the key of each row's text. Within, the id of a class is the least key of its texts."""
    spark = c.prepare(docs.sparkSession)
    parts = c.partitions(spark)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), _key(text_col).alias("key"))
    sketch = c.held(own.mapInArrow(_sketches(size), "id long, key long, n long, s1 long, s2 long, regs binary"))
    cls = c.held(sketch.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("key").alias("rep"), F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("regs").alias("regs")))
    bands = cls.select("rep", "regs")
    crowd = c.held(bands.mapInArrow(_bands(), "key long, id long").groupBy("key").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1"))
    # only bands that other classes have too go further
    bands = bands.mapInArrow(_bands(bloom.build(crowd.select("key"))), "key long, id long")
    signed = cls.select("rep", "n", "regs").mapInArrow(_signed, "id long, n long, sig binary").groupBy("id").agg(F.max("n").alias("n"), F.max("sig").alias("sig"))
    company = F.sum(F.when(F.col("crowd") > SMALL, F.col("crowd"))).over(Window.partitionBy("id"))  # at most a row a band
    shared = c.held(spread.join(bands, crowd, ["key"], F.col("crowd"), F.col("id")).join(signed, "id").withColumn("company", company))
    c.freed(spark)

    small = shared.where(F.col("crowd") <= SMALL).withColumn("g", F.pmod("key", F.lit(4 * parts)))
    pairs = c.held(small.select("g", "key", "id", "n", "sig").groupBy("g").applyInArrow(_trimming(_small_pairs(percent)), "a long, b long").distinct())

    large = shared.where(F.col("crowd") > SMALL)
    hub = large.groupBy("key").agg(F.max(F.struct("company", F.bitwise_not("id").alias("minus"))).alias("h"), F.first("crowd").alias("members"))
    hub = c.held(hub.select("key", F.bitwise_not("h.minus").alias("hub"), "members"))
    large = c.held(spread.join(large, hub, ["key"], F.col("members"), F.col("id")).drop("company", "members"))
    # members meet their hub in parts of some hundreds, each with a copy of the hub's set
    star = large.where("id <> hub").groupBy("id", "hub").agg(F.max("crowd").alias("crowd")).select("id", "hub", F.pmod(F.xxhash64("id"), F.ceil(F.col("crowd") / F.lit(BLOCK))).alias("part"))

    ids = c.held(pairs.select(F.explode(F.array("a", "b")).alias("id")).union(large.select("id")).distinct())
    texts = own.select(F.col("key").alias("id"), "text")
    known = None
    if 8 * ids.count() <= filter_bits:
        known = bloom.build(ids, filter_bits)
    else:  # such a filter would let most through, and their sets are large
        texts = texts.join(ids, "id", "left_semi")
    sets = c.held(texts.mapInArrow(_sets(size, known), "id long, regs binary, n long, elements binary").dropDuplicates(["id"]))
    c.freed(spark)

    def side(k: str) -> DataFrame:
        return sets.select(F.col("id").alias(k), F.col("regs").alias(f"r{k}"), F.col("n").alias(f"n{k}"), F.col("elements").alias(f"x{k}"))

    def verify(pairs: DataFrame) -> DataFrame:
        return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_verified(percent, least), "a long, b long")

    star = c.held(star.select(F.col("id").alias("a"), F.col("hub").alias("b"), "part"))
    hubs = star.select("b", "part").distinct().join(side("b"), "b")
    links = c.held(star.join(side("a"), "a").join(hubs, ["b", "part"]).mapInArrow(_verified(percent, least), "a long, b long"))
    if not large.isEmpty():
        # a label is a class that is surely connected: the least that the hub is linked with, for all that are linked with the hub
        least_of = links.groupBy("b").agg(F.least(F.min("a"), F.col("b")).alias("o"))
        parted = links.join(star, ["a", "b"])
        heard = parted.join(parted.select("b", "part").distinct().join(least_of, "b"), ["b", "part"]).select(F.col("a").alias("id"), "o")
        label = c.held(heard.unionByName(least_of.withColumnRenamed("b", "id")).groupBy("id").agg(F.min("o").alias("o")))
        placed = large.join(label, "id", "left").withColumn("component", F.coalesce("o", "id")).drop("o")
        # a bucket is one cell; one that is too large is a cell for each class of sizes, or several:
        # linked sets lie in one class or in two neighbouring ones
        whole = placed.where(F.col("crowd") <= 4 * BLOCK).withColumns({"g": F.col("key"), "high": F.lit(False)})
        columns = ["g", "key", "id", "component", "n", "high", "sig", "crowd", "hub"]
        cells = whole.select(*columns)
        if not large.where(F.col("crowd") > 4 * BLOCK).isEmpty():
            # classes with the hub's label need no look at each other, so no two cells of them meet
            hubs = hub.where(F.col("members") > 4 * BLOCK).join(label.select(F.col("id").alias("hub"), "o"), "hub", "left").select("key", F.coalesce("o", "hub").alias("home"), "members")
            rest = spread.join(placed.where(F.col("crowd") > 4 * BLOCK), c.held(hubs), ["key"], F.col("members"), F.col("id"))
            rest = c.held(rest.withColumns({"sizes": F.floor(F.log("n") / F.log(F.lit(100 / percent))).cast("int"), "out": F.col("component") != F.col("home")}).drop("home", "members"))
            count = c.held(rest.groupBy("key", "sizes", "out").agg(F.count(F.lit(1)).alias("members"), F.ceil(F.count(F.lit(1)) / F.lit(4 * BLOCK)).alias("blocks")))
            own_cells = count.select("key", "sizes", "out", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("cell"))
            other = own_cells.select("key", *[F.col(x).alias(f"{x}2") for x in ("sizes", "out", "cell")])
            met = own_cells.join(other, "key").where("(out or out2) and (sizes2 = sizes + 1 or sizes2 = sizes and (out < out2 or out = out2 and cell <= cell2))").withColumn("g", F.xxhash64("key", "sizes", "out", "cell", "sizes2", "out2", "cell2"))
            one = met.select("g", "key", "sizes", "out", "cell", F.lit(False).alias("high"))
            two = met.where("sizes2 > sizes or out2 <> out or cell2 > cell").select("g", "key", *[F.col(f"{x}2").alias(x) for x in ("sizes", "out", "cell")], F.lit(True).alias("high"))
            rest = spread.join(rest, count, ["key", "sizes", "out"], F.col("members"), F.col("id")).withColumn("cell", F.pmod(F.xxhash64("id"), F.col("blocks"))).drop("blocks", "members")
            cells = cells.unionByName(one.unionByName(two).join(rest, ["key", "sizes", "out", "cell"]).select(*columns))
        likely = c.held(cells.groupBy("g").applyInArrow(_trimming(_cell_pairs(percent)), "a long, b long, key long, component long, crowd long, hub long, n long"))
        found = likely.where("key is null").select("a", "b")
        dense = likely.where("key is not null").withColumnRenamed("a", "id")
        # a class lies in a block of the hub of its largest dense bucket; blocks that meet in a bucket are compared
        home = c.held(dense.groupBy("id", "component", "n").agg(F.max(F.struct("crowd", "key", "hub")).alias("h")).select("id", "component", "n", F.col("h.hub").alias("home")))
        count = c.held(home.groupBy("home").agg(F.count(F.lit(1)).alias("members"), F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(BLOCK), F.sum("n") / F.lit(BLOCK_ELEMENTS))).alias("blocks")))
        home = c.held(spread.join(home, count, ["home"], F.col("members"), F.col("id")).select("id", "component", F.xxhash64("home", F.pmod(F.xxhash64("id"), F.col("blocks"))).alias("block")))
        met = dense.select("key", "id").join(home, "id").select("key", "block").distinct()
        twos = c.held(met.join(met.withColumnRenamed("block", "other"), "key").where("block <= other").select("block", "other").distinct())
        held = twos.select(F.xxhash64("block", "other").alias("g"), F.explode(F.array_distinct(F.array("block", "other"))).alias("block"))
        held = held.join(home, "block").join(sets.select("id", "elements"), "id").select("g", "id", "component", "elements")
        links = links.unionByName(c.held(held.groupBy("g").applyInArrow(_trimming(_block_links(percent)), "a long, b long")))
        # pairs of small buckets that blocks have compared need no other look
        blocks = home.select("id", "block")
        pairs = pairs.join(blocks.select(F.col("id").alias("a"), F.col("block").alias("x")), "a", "left").join(blocks.select(F.col("id").alias("b"), F.col("block").alias("y")), "b", "left")
        pairs = pairs.select("a", "b", F.least("x", "y").alias("block"), F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.greatest("x", "y")).alias("other"))
        pairs = c.held(pairs.join(twos, ["block", "other"], "left_anti").select("a", "b").unionByName(found).distinct())
        c.freed(spark)
    comp = components(c.held(links.unionByName(verify(pairs))))
    c.freed(spark)

    comp = c.held(comp.withColumnRenamed("id", "rep").join(cls.select("rep", "first"), "rep"))
    reached = c.held(comp.groupBy("component").agg(F.min("first").alias("reached"), F.count(F.lit(1)).alias("members")))
    comp = spread.join(comp, reached, ["component"], F.col("members"), F.col("rep")).select("rep", "reached")
    cls = c.held(cls.select("s1", "s2", "n", "rep", "first", "copies").join(comp, "rep", "left").select("s1", "s2", "n", F.coalesce("reached", "first").alias("component"), "copies"))
    out = spread.join(sketch.select("id", "key", "n", "s1", "s2"), cls, ["s1", "s2", "n"], F.col("copies"), F.col("id"), "left")
    found = F.when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("component", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), found.alias("component_id"), F.coalesce(F.col("id") == found, found.isNull()).alias("kept"), "key")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with the least doc_id of their component, with all their columns."""
    gone, text = c.fresh(docs, "__gone"), c.fresh(docs, "__text")
    out = _linked(docs, id_col, text_col, **options).where("not kept").select(F.col("doc_id").alias(gone), F.col("key").alias(text)).distinct()
    return docs.join(out, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(gone)) & (_key(text_col) == F.col(text)), "left_anti")
