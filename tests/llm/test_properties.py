"""Properties of the parts that need no Spark, over generated texts."""

import re

import numpy as np
import pytest

pytest.importorskip("hypothesis")
from hypothesis import given, settings
from hypothesis import strategies as st

from tabloom.llm import common as c
from tabloom.llm import decontaminate, dom, near_dup, pii, substring_dedup

FAST = settings(max_examples=150, deadline=None)


@FAST
@given(st.lists(st.text(alphabet="ab \t\n\x0b\x0c\r\x1c\xa0é", max_size=40), max_size=6), st.booleans())
def test_words(texts, lower):
    import pyarrow as pa

    h, counts = c.hashed_words(pa.array(texts, pa.string()), lower)
    folded = [re.sub("[A-Z]+", lambda m: m[0].lower(), t) if lower else t for t in texts]
    want = [[w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", t)] for t in folded]
    words = [w for x in want for w in x]
    assert counts.tolist() == list(map(len, want)) and h.tolist() == c.word_hashes(pa.array(words, pa.large_binary())).tolist() == c.hash_list(words).tolist()
    assert len(set(h.tolist())) == len(set(words))


@FAST
@given(st.lists(st.lists(st.integers(0, 3), max_size=60), min_size=1, max_size=5), st.integers(2, 12))
def test_equal_windows_have_equal_anchors(docs, window):
    """Wherever a window stands, its anchor has one name and one place in it."""
    counts = np.array([len(d) for d in docs])
    h = c.mix(np.array([x for d in docs for x in d], np.uint64) + np.uint64(1))
    starts, name, first = substring_dedup.anchors(h, counts, window)
    flat = [x for d in docs for x in d]
    ends = np.cumsum(counts)
    want = [p for p in range(len(flat)) if any(e - n <= p and p + window <= e for e, n in zip(ends, counts))]
    assert starts.tolist() == want
    seen = {}
    for p, a, f in zip(starts.tolist(), name.tolist(), first.tolist()):
        key = tuple(flat[p : p + window])
        assert p <= f < p + window
        assert seen.setdefault(key, (a, f - p)) == (a, f - p)


@FAST
@given(st.lists(st.sets(st.integers(0, 400), max_size=120), min_size=2, max_size=12))
def test_common_counts(sets):
    own = [np.sort(c.mix(np.array(sorted(s), np.uint64))) for s in sets]
    got = near_dup.common_counts(own) if sum(map(len, own)) else np.zeros((len(sets), len(sets)))
    for i in range(len(sets)):
        for j in range(len(sets)):
            assert i == j or got[i, j] == len(sets[i] & sets[j])


@FAST
@given(st.text(alphabet="a1234@.+-() é", max_size=80))
def test_base_spans(text):
    got = pii.base_spans(text)
    assert got["email"] == [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    assert got["ip"] == [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    assert got["phone"] == [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


@FAST
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=20), max_size=6), st.lists(st.lists(st.sampled_from("abcd"), max_size=25), max_size=4))
def test_contamination(items, docs):
    import pyarrow as pa

    benchmark = decontaminate.Items([(str(i), 0, [x.encode() for x in w]) for i, w in enumerate(items)])
    got = [decontaminate.verdict(**h) for h in decontaminate.hits(pa.array([" ".join(d) for d in docs], pa.string()), benchmark)]
    for d, g in zip(docs, got):
        hit, found = [False] * len(d), set()
        for i, w in enumerate(items):
            for k in range(max(1, len(w) - 12) if w else 0):
                x = w[k : k + 13]
                for p in range(len(d) - len(x) + 1):
                    if d[p : p + len(x)] == x:
                        hit[p : p + len(x)] = [True] * len(x)
                        found.add(i)
        assert (g["n_words"], g["n_hit"], g["n_items"]) == (len(d), sum(hit), len(found))


@FAST
@given(st.text(alphabet="<>/ap!-\"'= b&;", max_size=60))
def test_any_markup_is_read(page):
    root = dom.parse(page)
    units, x, parent = dom.features(root)
    assert x.shape == (len(units), dom.FEATURES) if units else True
    assert np.isfinite(x).all() and all(p < i for i, p in enumerate(parent))
    assert isinstance(dom.block_text(root, np.ones(len(units), bool)), str)


tokenizers = pytest.importorskip("tokenizers")
VOCABULARY = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def codecs():
    from tabloom.llm.bpe import Codec

    with open(VOCABULARY, "rb") as f:
        return Codec(f.read()), tokenizers.Tokenizer.from_file(VOCABULARY)


@settings(max_examples=400, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.characters(max_codepoint=0x24F, exclude_categories=("Cs",)), st.sampled_from("aeiounrst' 'sΣé<|endoftext|>́")), max_size=40))
def test_tokens(codecs, text):
    mine, library = codecs
    ids = np.frombuffer(mine.encode(text), "<u4")
    want = library.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want and mine.decode(ids).decode() == library.decode(want, skip_special_tokens=False)
