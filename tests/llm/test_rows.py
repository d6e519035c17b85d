"""Near duplicates among rows that share a doc_id or have none."""

from tabloom.llm import near_dup

WORDS = [f"w{i}" for i in range(100)]
A, NEAR = " ".join(WORDS), " ".join([*WORDS[:-1], "other"])
B = " ".join(f"b{i}" for i in range(60))


def test_only_the_copy_of_an_id_goes(spark):
    docs = spark.createDataFrame([(1, A), (2, A), (2, B), (3, "lone words of a text here")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in near_dup.drop_near_duplicates(docs).collect()) == [(1, A), (2, B), (3, "lone words of a text here")]


def test_rows_without_id_are_linked(spark):
    docs = spark.createDataFrame([(1, A), (None, A), (None, NEAR), (None, B), (None, "")], "doc_id long, text string")
    got = near_dup.drop_near_duplicates(docs).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(1, A), (0, B), (0, "")])


def test_both_texts_of_an_id_link(spark):
    docs = spark.createDataFrame([(1, A), (1, B), (2, NEAR), (3, B)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in near_dup.link_components(docs).collect()) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)]
