"""Operators in DataFrame functions only, against plain Python."""

import hashlib
import re

from pyspark.sql import functions as F

from tabloom.llm import chat
from tabloom.llm import fingerprint as fp
from tabloom.llm import queries as q


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def print_of(text):
    def md5(x):
        return hashlib.md5(x.encode()).hexdigest()

    tree = [[[md5(m) for m in re.findall(r"(?s).{1,64}", p)] for p in s.split("\n")] for s in text.split("\n\n")]
    para = [[md5("".join(p)) for p in s] for s in tree]
    sec = [md5("".join(s)) for s in para]
    return "|".join([md5("".join(sec)), " ".join(f"{d[:8]}x{len(s)}" for d, s in zip(sec, tree)), " ".join(f"{d[:8]}x{len(p)}" for s, t in zip(para, tree) for d, p in zip(s, t)), " ".join(x[:8] for s in tree for p in s for x in p)])


def like(a, b):
    x, y = ({*z.split("|")[3].split(" ")} - {""} for z in (a, b))
    return 1.0 if a == b else 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


def check_fingerprints(got, docs):
    order = sorted(docs)
    for k, i in enumerate(order):
        text, following = docs[i] or "", docs[order[(k + 1) % len(order)]] or ""
        n = len(text) // 4
        edited = text[: len(text) - n] + following[:n]
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), sha(edited), print_of(text), print_of(edited)), i
        assert abs(r.near_edited - like(print_of(text), print_of(edited))) < 1e-9 and abs(r.near_next - like(print_of(text), print_of(following))) < 1e-9


def test_fingerprints(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check_fingerprints({r.doc_id: r for r in q.op5_fingerprint(spark, sf_dir).collect()}, docs)


def test_fingerprints_odd(spark):
    docs = {5: None, 7: "", 9: "a\n\nb\nc\n\n\nd", -3: "é😀" * 100, 12: "x" * 64, 100: "y" * 65 + "\n", 10**15: "end"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    check_fingerprints({r.doc_id: r for r in fp.edit_fingerprints(df).collect()}, docs)
    one = fp.edit_fingerprints(df.where("doc_id = 9")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_differing_paragraphs(spark):
    a, b = "one\ntwo\nthree\n\nfour", "one\n2\nthree\n\nfour\nfive"
    df = fp.fingerprints(fp.fingerprints(spark.createDataFrame([(a, b)], "x string, y string"), "x", "a"), "y", "b")
    r = df.select(fp.differing(F.col("a"), F.col("b")).alias("p"), fp.differing(F.col("a"), F.col("b"), 1).alias("s"), fp.differing(F.col("a"), F.col("a")).alias("none")).first()
    assert (r.p, r.s, r.none) == ([1, 4], [0, 1], [])


def check_conversations(got, rows):
    turns = {}
    for conv, turn, role, text in rows:
        turns.setdefault(conv, []).append((turn, role or "", text or ""))
    assert set(got) == set(turns)
    for k, own in turns.items():
        own.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        loss = "".join(t for _, r, t in own if r == "assistant")
        r = got[k]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), sha("".join(f"{a}\n{t}\n" for _, a, t in own)), len(loss), sha(loss)), k
        assert r.valid == bool(re.fullmatch("s?(ua)+", "".join(a[:1] if a in chat.TEMPLATE else "?" for _, a, _ in own)))


def test_chat(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, i, r, "</s>[INST] ok [/INST]") for i, r in enumerate(("user", "assistant"))]
    check_conversations({r.conv_id: r for r in q.op7_chat(spark, sf_dir).collect()}, rows)


def test_chat_odd(spark):
    odd = ["", None, "</s>", "<\\/s>", "<\\\\\\s>[\\INST]", "[/INST][INST]</s><s>", "[ROLE]x[/ROLE]", "\\", "<", "[/INST", "</", "[", "a\n\nb</s", "[OUT]<s>[SYS]"]
    rows = [(c, t, ("user", "assistant", "system", "tool", None, "</s>[/ROLE]")[(c + t * 5) % 6], odd[(c * 3 + t) % len(odd)]) for c in range(30) for t in range(c % 5 + 1)]
    rows += [(50, 1, "user", "x"), (50, 1, "user", "x"), (50, None, "system", "first"), (51, 2, "assistant", "b"), (51, 1, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(df)
    check_conversations({r.conv_id: r for r in chat.digests(out).collect()}, rows)
    for r in out.collect():
        assert "".join(s.text for s in r.segments) == r.formatted
        assert r.formatted.count("</s>") == sum(x[0] == r.conv_id for x in rows)
    bad = {r.conv_id: r.first_bad for r in out.collect()}
    assert bad[51] is None and bad[50] == 2


def test_no_python_in_plans(spark, sf_dir):
    for f in (q.op5_fingerprint, q.op7_chat):
        plan = f(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_each_level_is_digested_once(spark, sf_dir):
    """Own texts and edited ones, three levels of digests each, in projections that the optimiser leaves apart."""
    plan = q.op5_fingerprint(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 3  # the texts' own plan stands at both joins, whose exchange is one
