"""Operators with exact results, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tabloom.llm import queries as q


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t)


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_near_dup(spark, sf_dir, docs):
    got = rows(q.op1_near_dup(spark, sf_dir))
    assert_components({k: got[k] for k in got}, docs)


def brute_components(docs, percent):
    """(set size, least doc_id that links reach) of each document."""
    sets = {}
    for i, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    both = Counter()
    for own in where.values():
        for a in range(len(own)):
            for b in range(a + 1, len(own)):
                both[own[a], own[b]] += 1
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def assert_components(got, docs):
    for i, (n, least) in brute_components(docs, 85).items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, least, least == i), i


@pytest.mark.parametrize(("small", "block", "hot"), [(3, 32, 1000), (3, 8, 20), (48, 512, 5)])
def test_near_dup_chains_and_large_groups(spark, monkeypatch, small, block, hot):
    """Variants that the hub does not link, chains, a bucket of many blocks and of many cells, keys that are dealt over tasks."""
    from tabloom.llm import near_dup, spread

    r = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    docs = {}
    for i in range(120):
        x = list(base)
        for _ in range(r.choice((0, 1, 2, 3, 4, 6, 9))):
            x[r.randrange(200)] = f"y{r.random()}"
        docs[i] = " ".join(x)
    long = [f"z{i}" for i in range(400)]
    for i in range(20):  # a chain: each step changes a part
        docs[200 + i] = " ".join(long[5 * i : 300 + 5 * i])
    docs |= {300: "a b", 301: "A B", 302: "a b c", 303: "", 304: None}
    monkeypatch.setattr(near_dup, "SMALL", small)
    monkeypatch.setattr(near_dup, "BLOCK", block)
    monkeypatch.setattr(spread, "HOT_ROWS", hot)
    seen, join = [], spread.join
    monkeypatch.setattr(spread, "join", lambda many, one, on, *rest: seen.append(on) or join(many, one, on, *rest))
    got = rows(near_dup.link_components(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), filter_bits=8 if block == 32 else 1 << 30))
    assert_components(got, docs)
    assert (["key", "sizes", "out"] in seen) == (block == 8)


def test_estimate_is_near_the_truth():
    import numpy as np

    from tabloom.llm import common as c
    from tabloom.llm import near_dup as n

    x = c.mix(np.arange(3000, dtype=np.uint64))
    a, b = x[:2500], x[500:]  # 2000 of 3000
    regs = n.registers(np.r_[a, b], np.array([2500, 2500]))
    got = n.estimate(regs[:1], regs[1:], np.array([2500]), np.array([2500]))[0]
    assert abs(got - 2 / 3) < 0.12


def contamination(docs, bench):
    windows, out = defaultdict(set), {}

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))

    for i, t in bench:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(str(i))
    for i, t in docs.items():
        w = words(t)
        hit, items, whole = [False] * len(w), set(), False
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if s := windows.get(tuple(w[k : k + n])):
                    hit[k : k + n] = [True] * n
                    items |= s
                    whole |= n == 13
        share = sum(hit) > 0 and 20 * sum(hit) >= len(w)
        out[i] = (len(w), sum(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), share, whole or share)
    return out


def test_decontaminate(spark, sf_dir, docs):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = rows(q.op6_decontaminate(spark, sf_dir))
    want = contamination(docs, bench)
    assert {k: tuple(r)[1:6] for k, r in got.items()} == {k: w[:5] for k, w in want.items()}
    assert any(w[4] for w in want.values())


@pytest.mark.parametrize("slice_words", [1_000_000, 30])
def test_decontaminate_small(spark, slice_words):
    """Short items, prefixes of items, overlaps, repeated items; in one pass and in many."""
    from tabloom.llm.decontaminate import find_contamination, remove_contaminated

    r = random.Random(5)
    pool = [f"v{i}" for i in range(12)]
    bench = [(i, " ".join(r.choice(pool) for _ in range(r.choice((1, 2, 3, 5, 12, 13, 14, 30))))) for i in range(25)] + [(3, "a b c"), (99, None), (98, "!!")]
    docs = {i: " ".join(r.choice(pool + ["A", "b", "C"]) for _ in range(r.choice((0, 1, 4, 40)))) for i in range(60)}
    for i in range(60, 75):
        docs[i] = " ".join([f"x{i}"] * 5 + [r.choice(bench)[1] or ""] + [f"u{i}"] * 3)
    for i in range(75, 80):  # a whole window in a long text is a small share of it
        docs[i] = " ".join([f"x{i}"] * 300 + [f"v{k % 12}" for k in range(13)] + [f"u{i}"] * 300)
    bench.append((97, " ".join(f"v{k % 12}" for k in range(20))))
    docs[80] = None
    df, b = spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    got = rows(find_contamination(df, b, slice_words=slice_words))
    want = contamination(docs, bench)
    assert {k: tuple(x)[1:6] + (x.affected,) for k, x in got.items()} == want
    assert all(want[i][5] and not want[i][4] for i in range(75, 80))
    left = {x.doc_id for x in remove_contaminated(df.withColumn("n_hit", F.lit("mine")), b, slice_words=slice_words).collect()}
    assert left == {k for k, w in want.items() if not w[5]}


def odd_words(k):
    """Two different words of 2**k bytes whose polynomial hashes modulo a power of two agree."""
    a = "a"
    for _ in range(k):
        a += a.translate({97: 98, 98: 97})
    return a, a.translate({97: 98, 98: 97})


@pytest.mark.parametrize("k", [10, 11, 12])
def test_words_of_like_polynomials(spark, k):
    """Words, and sequences of two words, made so that polynomial hashes take them for equal."""
    from tabloom.llm.decontaminate import find_contamination
    from tabloom.llm.near_dup import link_components
    from tabloom.llm.substring_dedup import dedup_substrings

    one, two = odd_words(k)
    x, y = ([{"a": "left", "b": "right"}[z] for z in w] for w in odd_words(6))
    common = [f"c{i}" for i in range(34)]
    texts = {1: " ".join([*common, one]), 2: " ".join([*common, two]), 3: " ".join(x), 4: " ".join(y), 5: f"{one} b c d e", 6: f"{two} b c d e"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {i: tuple(r)[1:4] for i, r in rows(dedup_substrings(docs)).items()} == without_repeats(texts)
    assert_components(rows(link_components(docs)), texts)
    bench = [(1, " ".join([*common[-12:], two])), (2, " ".join(y[:40]))]
    got = rows(find_contamination(docs, spark.createDataFrame(bench, "item_id long, text string")))
    assert {i: tuple(r)[1:6] + (r.affected,) for i, r in got.items()} == contamination(texts, bench)


def test_longest_match_across_slices(spark):
    from tabloom.llm.decontaminate import find_contamination

    item = [f"b{i}" for i in range(200)]
    docs = spark.createDataFrame([(1, " ".join(["p"] * 4 + item[5:180] + ["q"]))], "doc_id long, text string")
    for n in (1_000_000, 40, 27):
        r = find_contamination(docs, spark.createDataFrame([(7, " ".join(item)), (8, "p"), (9, None)], "item_id long, text string"), slice_words=n).collect()[0]
        assert (r.longest, r.longest_start, r.longest_item, r.n_hit, r.n_items) == (175, 4, "7", 179, 2), n


def test_longest_match(spark):
    from tabloom.llm.decontaminate import find_contamination

    item = [f"b{i}" for i in range(40)]
    docs = [(1, " ".join(["p"] * 4 + item[5:35] + ["q"])), (2, " ".join(item[:12]))]
    got = rows(find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")))
    assert (got[1].longest, got[1].longest_start, got[1].longest_item, got[1].n_hit) == (30, 4, "7", 30)
    assert (got[2].longest, got[2].longest_start, got[2].n_hit) == (0, None, 0)


def without_repeats(docs, window=35):
    words = {i: (t or "").encode().split() for i, t in docs.items()}
    count = Counter(tuple(w[k : k + window]) for w in words.values() for k in range(len(w) - window + 1))
    out = {}
    for i, w in words.items():
        keep = [True] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                keep[k : k + window] = [False] * window
        left = [x for x, y in zip(w, keep) if y]
        out[i] = (len(w), len(w) - len(left), hashlib.sha256(b" ".join(left)).hexdigest())
    return out


def test_substring_dedup(spark, sf_dir, docs):
    got = rows(q.op9_substring_dedup(spark, sf_dir))
    assert {k: tuple(r)[1:] for k, r in got.items()} == without_repeats(docs)


@pytest.mark.parametrize(("window", "segment", "filter_bits", "hot"), [(35, 500_000, 1 << 30, 64), (35, 7, 1 << 30, 1), (6, 20, 1 << 30, 3), (6, 20, 8, 64), (35, 500_000, 8, 64), (2, 7, 1 << 30, 2)])
def test_substring_dedup_small(spark, window, segment, filter_bits, hot):
    """Runs, periods, passages at the ends, few different words; anchors compared in one step and in two."""
    from tabloom.llm.substring_dedup import dedup_substrings

    r = random.Random(window)
    passage = [f"p{i}" for i in range(60)]
    docs = {i: " ".join(r.choice("abc") for _ in range(r.choice((0, 1, 30, 90)))) for i in range(30)}
    docs |= {40 + i: " ".join([f"l{i}"] * i + passage[i : 40 + i] + [f"r{i}"] * 3) for i in range(12)}
    docs |= {60: "run " * 50, 61: "run " * 35, 62: "run " * 34, 63: "x y " * 60, 64: " ".join(passage), 65: " ".join(passage), 66: None, 67: "é\xa0ü " * 3}
    got = rows(dedup_substrings(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), window=window, segment=segment, filter_bits=filter_bits, hot=hot))
    assert {k: tuple(x)[1:4] for k, x in got.items()} == without_repeats(docs, window)


VOCABULARY = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(VOCABULARY)


def test_bpe(spark, sf_dir, docs, library):
    import struct

    got = rows(q.op8_bpe(spark, sf_dir))
    for i, t in docs.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_other_kinds_of_vocabularies_are_refused():
    import json

    from tabloom.llm.bpe import Codec

    with open(VOCABULARY, "rb") as f:
        spec = json.load(f)
    for k, v in (("normalizer", None), ("decoder", {"type": "ByteLevel"}), ("pre_tokenizer", {"type": "ByteLevel"})):
        with pytest.raises(ValueError, match=k):
            Codec(json.dumps(spec | {k: v}).encode())
    with pytest.raises(ValueError, match="byte_fallback"):
        Codec(json.dumps(spec | {"model": spec["model"] | {"byte_fallback": True}}).encode())


def test_bpe_odd_texts(library):
    import numpy as np
    from tabloom.llm.bpe import Codec

    with open(VOCABULARY, "rb") as f:
        codec = Codec(f.read())
    r = random.Random(8)
    texts = ["", " ", "\x1c\x1d a\x1eb", "it's I'LL we'd've 's's", "a<|endoftext|>b <|startoftext|><|endoftext|", "ΣΑΣ Σ İI ǅ ﬁ 𝔘 ½ ² Ⅷ", "é ́x", " 　\x85\xa0z", "x" * 5000, "日本語 한국어 ไทย العربية", "\U0001f600\U0001f468‍\U0001f469"]
    texts += ["".join(r.choice("abcdeinorst' ") for _ in range(40)) for _ in range(500)]
    texts += ["".join(chr(r.choice((r.randrange(32, 127), r.randrange(160, 0x250), r.randrange(0x370, 0x500)))) for _ in range(30)) for _ in range(300)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        mine = np.frombuffer(codec.encode(t), "<u4")
        assert mine.tolist() == ids, t
        assert codec.decode(mine).decode() == library.decode(ids, skip_special_tokens=False), t
