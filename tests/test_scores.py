"""Scores of whole texts against brute force."""

import re

import pytest

from tabloom import queries as q
from tabloom.functions import score as sc

LONG = "filler words that reach well past the sixtieth character of the text, so "
TEXTS = [
    LONG + "part ii of v came on 3 jan, yes",
    LONG + "part 2 of 5 came on 3 January; true",
    LONG + "Teil IX im Dec: no $5 gain",
    LONG + "teil 9 im december, false 5 % gain",
    "x",
    "10",
    "été à la plage, i",
    "Été 1 plage",
    "1,000.00",
    "1000.004",
    "",
    "sept 1st at 20°C",
    "2021-09-01",
    "1 september 2021",
    None,
    "vi",
]


def normal(t):
    t = t.lower().strip()
    m = re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)", t)
    if m and 1 <= int(m[2]) <= 12:
        t = f"{int(m[3])} {sc.MONTHS[int(m[2]) - 1]} {m[1]}"
    t = re.sub(r"^([+-]?\d+)\.0+$", r"\1", t.replace(",", ""))
    same = {**sc.SHORT_MONTHS, **sc.ORDINALS, **sc.ROMANS, **sc.TRUTH}
    t = re.sub(r"\w+", lambda m: same.get(m[0], m[0]), t)
    for rx, new in ((r"[@;|]", " "), (r"\s*%\s*", " percent "), (r"\$\s*", ""), (r"\s*°[cf]?\b", ""), (r"[^\w\s]", " ")):
        t = re.sub(rx, new, t)
    return " ".join(t.split())


def f1(p, t):
    a, b = normal(p), normal(t)
    if a == b:
        return 1.0
    try:
        if abs(float(p.replace(",", "")) - float(t.replace(",", ""))) < 0.01:
            return 1.0
    except ValueError:
        pass
    s, u = set(a.split()), set(b.split())
    return 2 * len(s & u) / (len(s) + len(u)) if s & u else 0.0


def test_whole_texts_of_all_documents(spark, tmp_path):
    rows = [(i, t, ("en", "fr", "de", "es")[i % 4]) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.f1 for r in q.QUERIES["score_token_f1"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(len(TEXTS)))
    for i, (t, other) in enumerate(zip(TEXTS, [*TEXTS[1:], None])):
        assert got[i] == (None if t is None or other is None else pytest.approx(f1(t, other), abs=1e-9)), (t, other)
    assert got[0] > 0.9 and got[4] == got[8] == got[12] == 1.0
