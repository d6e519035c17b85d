"""Every operator over nulls, empty and long texts, repeated rows, empty tables and columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from tabloom.llm import bpe, chat, decontaminate, fingerprint, html_text, near_dup, pii, quality, substring_dedup, toxicity

VOCABULARY = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
LONG = "very long text " * 40_000
ROWS = [(1, "the same text of some words here", 1), (1, "the same text of some words here", 1), (2, "the same text of some words here", 0), (3, None, None), (None, "no id at all", 1), (None, None, 0), (4, "", 1), (5, " \t\n ", 0), (6, LONG, 1), (7, "x" * 300_000, 0), (8, "idiot moron scum", 1)]
LABELS = [(1, 1, 0), (2, 0, 0), (None, 1, 1), (4, None, 0), (8, 0, 1), (8, 1, 0), (6, 1, None)]
CLASHING = ["id", "tag", "n", "start", "key", "score", "rep", "component", "h", "k", "n_words", "text2", "__text", "label", "held_out"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([r[:2] for r in ROWS], "doc_id long, text string")
    return df.select(*[F.lit("clash").alias(x) for x in CLASHING], "*")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash")).withColumn("label", F.lit("clash"))


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "text of some words here"), (2, None), (None, "very long"), (2, "")], "item_id long, text string").withColumn("doc_id", F.lit("clash"))


def run(name, docs, labels, bench):
    return {
        "near_dup": lambda: near_dup.link_components(docs),
        "quality": lambda: quality.score_quality(docs, labels),
        "pii": lambda: pii.find_personal_data(docs),
        "toxicity": lambda: toxicity.score_toxicity(docs, labels),
        "fingerprint": lambda: fingerprint.edit_fingerprints(docs),
        "decontaminate": lambda: decontaminate.find_contamination(docs, bench),
        "bpe": lambda: bpe.encode(docs, VOCABULARY),
        "substring_dedup": lambda: substring_dedup.dedup_substrings(docs),
        "html_text": lambda: html_text.extract_main_text(docs.withColumn("url", F.lit(None).cast("string")), "doc_id", "url", "text"),
    }[name]().collect()


NAMES = ["near_dup", "quality", "pii", "toxicity", "fingerprint", "decontaminate", "bpe", "substring_dedup", "html_text"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(name, docs, labels, bench):
    got = run(name, docs, labels, bench)
    assert len(got) == len(ROWS)
    key = "page_id" if name == "html_text" else "doc_id"
    assert sorted((r[key] is None, r[key]) for r in got if r[key] is not None) == sorted((False, r[0]) for r in ROWS if r[0] is not None)
    same = {str(r) for r in got if r[key] == 1}
    assert len(same) == 1, "repeated rows differ"


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(name, docs, labels, bench):
    assert run(name, docs.limit(0), labels.limit(0), bench.limit(0)) == []


@pytest.mark.parametrize("name", ["quality", "toxicity", "decontaminate"])
def test_nothing_to_learn_from(name, docs, labels, bench):
    got = run(name, docs, labels.limit(0), bench.limit(0))
    assert len(got) == len(ROWS)
    if name == "quality":
        assert {r.score for r in got} == {0.5}
    if name == "decontaminate":
        assert not any(r.contaminated or r.n_hit for r in got)


def test_values(docs, labels, bench):
    got = {r.doc_id: r for r in run("near_dup", docs, labels, bench)}
    assert [(got[i].component_id, got[i].kept) for i in (1, 2, 3, 4, 5, 6)] == [(1, True), (1, False), (3, True), (4, True), (5, True), (6, True)]
    assert got[3].n_shingles == 0 and got[6].n_shingles == 3
    got = {r.doc_id: r for r in run("substring_dedup", docs, labels, bench)}
    assert got[6].n_removed == 120_000 and got[7].n_words == 1 and got[3].n_words == 0
    got = {r.doc_id: r for r in run("decontaminate", docs, labels, bench)}
    assert got[2].n_hit == 5 and got[6].n_hit == 80_000 and got[3].n_words == 0 and not got[3].contaminated


def test_filters_keep_all_columns(docs, labels, bench):
    for out in (near_dup.drop_near_duplicates(docs), toxicity.drop_toxic(docs, labels), decontaminate.remove_contaminated(docs, bench), pii.redact(docs)):
        assert out.columns == docs.columns
        assert out.where("text is null").count() == 2
    assert near_dup.drop_near_duplicates(docs).where("doc_id = 2").count() == 0


def test_empty_conversations_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, None, None, None), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string").withColumn("t", F.lit(1)).withColumn("turns", F.lit(2)).withColumn("loss", F.lit(3))
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    assert got[None].n_turns == 1 and not got[None].valid and not got[1].valid
    assert chat.digests(chat.format_conversations(df.limit(0))).collect() == []
