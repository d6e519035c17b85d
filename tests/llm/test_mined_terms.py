"""Mined terms are as many as pass the test."""

import random

from tabloom.llm.toxicity import Voters, mine


def test_all_terms_that_pass_are_kept(spark):
    r = random.Random(5)
    bad, good = ([f"{a}{b}{c}" for b in "abcdefghij" for c in "klmnopqrstuvwxyzabcdefghijklmn"[:26]] for a in "zq")
    rows = [(" ".join(r.sample(bad, 60)), 1) for _ in range(300)] + [(" ".join(r.sample(good, 60)), 0) for _ in range(300)]
    words, stems, pairs = mine(spark.createDataFrame(rows, "text string, label int"))
    assert sorted(words) == sorted(bad) and not stems and not pairs


def test_stems_that_tell_only_in_pairs(spark):
    """A stem that most clean texts have once and toxic ones have twice or more, never in the same word."""
    r = random.Random(6)

    def text(n):
        return " ".join([*("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(50)), *("zorka" + "".join(r.choice("uvwxy") for _ in range(5)) for _ in range(n))])

    rows = [(text(r.choice((2, 3, 4))), 1) for _ in range(150)] + [(text(r.choice((0, 1, 1))), 0) for _ in range(300)]
    words, stems, pairs = mine(spark.createDataFrame(rows, "text string, label int"))
    assert "zorka" in pairs and "zorka" not in stems
    voters = Voters(words, stems, pairs)
    no_term = 1 << (len(voters.names) - 1)
    assert voters.see(text(1))[0] & no_term and not voters.see(text(2))[0] & no_term
    assert voters.see(text(2) + " word" * 1000)[0] & no_term  # two by chance in a long text
