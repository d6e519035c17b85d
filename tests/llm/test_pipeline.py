"""The pipeline over the smallest tables: each stage's decisions hold in the next one's input."""

import hashlib
import os
import struct
import sys

import corpus_pipeline as p
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from test_exact import brute_components, contamination


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = [docs.count()]
    for i, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        counts.append(after.count())
        if i + 1 < len(p.STAGES):
            assert after.columns == docs.columns, name
            if name != "personal_data":  # kept rows are unchanged
                assert after.exceptAll(docs).count() == 0
            docs = after
    assert counts == sorted(counts, reverse=True) and counts[3] == counts[4] == counts[5]
    assert counts[0] > counts[1] > counts[2] > counts[3] > 0.6 * counts[0]
    assert docs.where(F.col("text").rlike(r"[0-9]@|@[a-z0-9]+\.example\.com")).count() == 0
    assert p.run(spark, sf_dir).count() == counts[-1]


def expected(spark, docs, labels, bench, library):
    """doc_id, ids and decoded texts, one plain stage after the other; the trained models score text by text."""
    from tabloom.llm import pii, toxicity

    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    model = toxicity.fit(df, labels)
    kept = {i: t for i, t in docs.items() if model.scores([t or ""])[0] < toxicity.THRESHOLD}
    kept = {i: kept[i] for i, (_, least) in brute_components(kept, 80).items() if least == i}
    kept = {i: kept[i] for i, found in contamination(kept, bench).items() if not found[5]}
    model = pii.fit(spark.createDataFrame(list(kept.items()), "doc_id long, text string"))
    out = {}
    for i, t in kept.items():
        text, at = "", 0
        for kind, s, e in sorted(((k, s, e) for k, s, e, _ in pii.spans(t, model)), key=lambda x: (x[1], -x[2])):
            if s >= at:
                text, at = text + (t or "")[at:s] + f"[{kind.upper()}]", e
            else:
                at = max(at, e)
        ids = library.encode(text + (t or "")[at:], add_special_tokens=False).ids
        out[i] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))


def test_run_against_plain_stages(spark, sf_dir, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in p.run(spark, sf_dir).collect()}
    assert got == expected(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), bench, library)


def test_no_window_of_the_benchmark_is_left(spark, sf_dir):
    """Where passages are a small part of long texts too."""
    big = os.path.join(os.path.dirname(sf_dir), "sf0.01")
    sf_dir = big if os.path.isdir(big) else sf_dir
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before = contamination({r.doc_id: r.text for r in docs.collect()}, bench)
    left = {r.doc_id: r.text for r in p.decontamination(spark, docs, sf_dir).collect()}
    assert set(left) == {i for i, x in before.items() if not x[1]}  # its items all have a whole window
    assert sf_dir != big or any(x[1] and not x[4] for x in before.values())
    assert not any(x[1] for x in contamination(left, bench).values())


@pytest.mark.parametrize("empty", [False, True])
def test_run_over_odd_rows(spark, tmp_path, library, empty):
    """Null and empty texts, no ids, repeated rows, another column; and no row at all."""
    rows = [(1, "the same text of some words here", "x"), (1, "the same text of some words here", "x"), (2, None, None), (None, None, "x"), (None, "no id at all", "x"), (3, "", "x"), (4, "mail me: a.b@example.com", "x"), (5, "long word " * 30_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.limit(0) if empty else docs
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0, 1), (2, None, None)], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (None, "text"), (2, "some words of an item that has more than thirteen words in it all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = p.run(spark, str(tmp_path)).collect()
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in out)
    # one word is a twentieth and more of the first text, and its repeated row goes with it
    assert ids == ([] if empty else [(False, 2), (False, 3), (False, 4), (False, 5), (True, 0), (True, 0)])
    assert empty or {r.n_tokens for r in out if r.doc_id in (2, 3)} == {0}
