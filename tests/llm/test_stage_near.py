"""The threshold of the pipeline's near-duplicate stage."""

import corpus_pipeline


def text(changed):
    return " ".join([*(f"w{i}" for i in range(304 - changed)), *(f"x{i}" for i in range(changed))])


def test_copies_from_four_fifths_on_go(spark):
    # 300 shingles each; with k changed at the end, (300 - k) of (300 + k) are common
    docs = spark.createDataFrame([(1, text(0)), (2, text(33)), (3, "w " * 40)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 3]
    docs = spark.createDataFrame([(1, text(0)), (2, text(34))], "doc_id long, text string")
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == 2
