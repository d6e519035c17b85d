"""Toxicity by weak supervision.

Voters are small lexicons (insults written down here, words and stems mined from the
training labels, and stems that tell only where two words have them, dealt out over several
voters) and patterns (several hits, dense hits, hits near "you", no hit at all). A generative model says how often each voter fires on
toxic and on clean texts; expectation maximisation estimates that from the vote patterns
of all documents, the training label being one more voter where there is one. Voters that
fire together more than the model explains share their weight, by their estimated
correlation. The posteriors label the training sample, and a logistic classifier over
votes and hit statistics is trained on them; it scores every text.

Mining takes a bounded sample (``most_labelled`` of either label). Copies would make any
of their words look like a toxic term, so of texts that agree in one of four min-hashes
one counts. A term counts if chance makes none such (a likelihood-ratio test corrected for
the number of terms) and over four fifths of the texts with it are toxic; all such terms
vote, as many as the bounded sample has.

Edge cases: null and empty texts have no hits and score as clean texts do; without
labels only the written lexicons vote; null ids are kept and not held out; repeated rows
get equal scores; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from .labelled import held_out, training_rows

#: Labelled texts of either label that are mined, lengths of stems.
MOST_LABELLED, STEMS = 4000, (4, 5, 6, 7)
#: A stem that tells only where two words have it needs one of them in so many words.
PAIR_SPAN = 250
#: Words that a task remembers, and what marks those with such a stem.
MOST_WORDS, HALF = 200_000, 1 << 40
#: The score from which a text counts as toxic.
THRESHOLD = 0.7
#: Written lexicons, by voter.
LEXICONS = {
    "wits": "idiot idiots stupid moron moronic imbecile dumb fool dimwit cretin halfwit",
    "worth": "worthless loser losers pathetic useless nobody failure",
    "disgust": "disgusting scum trash filth filthy vermin vile garbage",
    "mockery": "clown ugly freak creep jerk bastard",
    "french": "idiote imbécile crétin connard salaud ordure débile abruti",
    "german": "idioten dummkopf arschloch abschaum trottel versager widerlich",
    "spanish": "imbécil estúpido estúpida basura asqueroso tonto inútil escoria",
}
MINED_WORD_VOTERS, MINED_STEM_VOTERS, MINED_PAIR_VOTERS = 4, 4, 4
YOU = frozenset(x.encode() for x in "you your youre du dein ihr tu toi vous tú usted eres".split())
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _paired(n: int, words: int) -> bool:
    """Whether so many different words of a stem in a text of so many words are more than one by chance."""
    return n > 1 and PAIR_SPAN * n >= words


def tokens(text: str) -> list[bytes]:
    """Lower-case words."""
    return text.lower().encode().translate(_TABLE).split() if text else []


class Voters:
    """All voters, and what they see in a text."""

    def __init__(self, words: list[str], stems: list[str], pairs: list[str] = ()):
        mined = [(f"mined {what} {i}", n) for what, n in (("words", MINED_WORD_VOTERS), ("stems", MINED_STEM_VOTERS), ("pairs", MINED_PAIR_VOTERS)) for i in range(n)]
        self.names = [*LEXICONS, *(x for x, _ in mined), "two terms", "three terms", "dense", "near you", "no term"]
        self.lexical = len(LEXICONS) + len(mined)

        def dealt(terms: list[str], first: int, n: int) -> dict[str, int]:
            return {w: 1 << (first + i % n) for i, w in enumerate(terms)}

        at = len(LEXICONS)
        self.words: dict[bytes, int] = {w.encode(): 1 << i for i, x in enumerate(LEXICONS.values()) for w in x.split()}
        for w, bit in dealt(words, at, MINED_WORD_VOTERS).items():
            self.words[w.encode()] = self.words.get(w.encode(), 0) | bit
        self.stems = dealt(stems, at + MINED_WORD_VOTERS, MINED_STEM_VOTERS)
        self.pairs = dealt(pairs, at + MINED_WORD_VOTERS + MINED_STEM_VOTERS, MINED_PAIR_VOTERS)
        self.lengths = sorted({len(x) for x in (*stems, *pairs)})
        self.known: dict[bytes, int] = {}

    def _stems(self, word: bytes) -> list[str]:
        w = word.decode()
        return [w[:k] for k in self.lengths if len(w) > k]

    def _of(self, word: bytes) -> int:
        """The votes of a word, and ``HALF`` if it has a stem that counts only where two words have it."""
        bits = self.words.get(word, 0)
        for x in self._stems(word) if self.lengths else ():
            bits |= self.stems.get(x, 0) | (HALF if x in self.pairs else 0)
        return bits

    def see(self, text: str) -> tuple[int, tuple[float, ...]]:
        """The votes as bits, and statistics of the hits: distinct terms, hits a hundred words, share of voters."""
        words = tokens(text)
        kinds = set(words)
        known = self.known
        if len(known) > MOST_WORDS:
            known.clear()
        hit = {}
        halves: dict[str, list[bytes]] = {}
        for w in kinds:
            b = known.get(w)
            if b is None:
                b = known[w] = self._of(w)
            if b & HALF:
                for x in self._stems(w):
                    if x in self.pairs:
                        halves.setdefault(x, []).append(w)
                b ^= HALF
            if b:
                hit[w] = b
        for x, own in halves.items():
            if _paired(len(own), len(words)):
                for w in own:
                    hit[w] = hit.get(w, 0) | self.pairs[x]
        bits = 0
        for b in hit.values():
            bits |= b
        n = sum(1 for w in words if w in hit) if hit else 0
        dense = 100 * n / max(len(words), 1)
        near = False
        if hit and YOU & kinds:
            near = any(words[i] in hit and YOU & set(words[max(0, i - 3) : i + 4]) for i in range(len(words)))
        for k, x in enumerate((len(hit) >= 2, len(hit) >= 3, dense >= 1, near, not hit)):
            bits |= int(x) << (self.lexical + k)
        return bits, (math.log1p(len(hit)), math.log1p(n), math.log1p(dense), bin(bits & ((1 << self.lexical) - 1)).count("1") / 4)


def _matrix(bits: np.ndarray, n: int) -> np.ndarray:
    return ((bits.reshape(-1, 1) >> np.arange(n)) & 1).astype(float)


class LabelModel:
    """Firing rates of the voters on toxic and clean texts, and their correlations.

    ``bits`` and ``weight``: vote patterns and how many texts have each; ``gold``: the
    training label of the texts of a pattern, or -1.
    """

    def __init__(self, bits: np.ndarray, weight: np.ndarray, gold: np.ndarray, voters: int, rounds: int = 100):
        x = _matrix(bits, voters)
        self.voters = voters
        fires = np.full(voters, 0.3)
        fires[-1] = 0.1  # "no term" speaks for clean
        quiet = np.full(voters, 0.02)
        quiet[-1] = 0.9
        self.share, right = 0.1, np.array([0.95, 0.95])  # of toxic texts; how often labels are right, by truth
        # pseudo-texts that hold each rate near where it starts until the counts say more
        start, hold = np.stack([quiet, fires]), 4.0
        rates = start.copy()
        discount = np.ones(voters)
        post = np.zeros(len(x))
        for turn in range(2):
            for _ in range(rounds):
                odds = math.log(self.share / (1 - self.share)) + (x * np.log(rates[1] / rates[0]) + (1 - x) * np.log((1 - rates[1]) / (1 - rates[0]))) @ discount
                odds = odds + np.where(gold == 1, math.log(right[1] / (1 - right[0])), np.where(gold == 0, math.log((1 - right[1]) / right[0]), 0))
                new = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
                moved, post = np.abs(new - post).max(initial=0), new
                for y, p in ((0, 1 - post), (1, post)):
                    w = weight * p
                    rates[y] = np.clip((w @ x + hold * start[y]) / (w.sum() + hold), 1e-4, 1 - 1e-4)
                    told = w * (gold >= 0)
                    right[y] = np.clip(((told * (gold == y)).sum() + 19) / (told.sum() + 20), 0.6, 0.999)
                self.share = float(np.clip(((weight * post).sum() + 1) / (weight.sum() + 10), 1e-3, 0.9))
                if moved < 1e-6:
                    break
            # what is left of the voters' covariance once the truth is known
            cov, var = np.zeros((voters, voters)), np.zeros(voters)
            for y, p in ((0, 1 - post), (1, post)):
                d = x - rates[y]
                cov += (d * (weight * p)[:, None]).T @ d
                var += ((d**2) * (weight * p)[:, None]).sum(axis=0)
            self.correlation = cov / np.sqrt(np.outer(var, var) + 1e-9)
            if turn == 0:
                up = np.clip(self.correlation - np.diag(np.diag(self.correlation)), 0, 1)
                discount = 1 / (1 + up.sum(axis=1))
        self.rates, self.right, self.discount = rates, right, discount
        self.posterior = post


class Classifier:
    """Logistic regression over the votes and the statistics of the hits."""

    def __init__(self, voters: Voters, bits: np.ndarray, stats: np.ndarray, target: np.ndarray, weight: np.ndarray):
        self.voters = voters
        f = self.features(bits, stats)
        self.weights = np.zeros(f.shape[1])
        self.weights[-1] = -2.0
        penalty = np.full(f.shape[1], 0.3)
        penalty[-1] = 1e-3
        start = self.weights.copy()
        for _ in range(40):
            z = 1 / (1 + np.exp(-np.clip(f @ self.weights, -30, 30)))
            g = f.T @ (weight * (target - z)) - penalty * (self.weights - start)
            h = (f * (weight * z * (1 - z))[:, None]).T @ f + np.diag(penalty)
            step = np.linalg.solve(h, g)
            self.weights += step * min(1, 4 / max(np.abs(step).max(), 1e-9))
            if np.abs(step).max() < 1e-6:
                break

    def features(self, bits: np.ndarray, stats: np.ndarray) -> np.ndarray:
        return np.hstack([_matrix(bits, len(self.voters.names)), stats.reshape(len(bits), 4), np.ones((len(bits), 1))])

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        seen = [self.voters.see(x or "") for x in texts]
        f = self.features(np.array([b for b, _ in seen], np.int64), np.array([s for _, s in seen]))
        return 1 / (1 + np.exp(-np.clip(f @ self.weights, -30, 30)))


def _min_hashes(text: str) -> list[int]:
    h = c.hash_list(tokens(text))
    if len(h) > 4:
        h = c.sequence_hashes(h, np.arange(len(h) - 4), 5, 60)
    return [int(c.mix(h, k).min().view(np.int64)) if len(h) else 0 for k in (61, 62, 63, 64)]


def mine(rows: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """Words and stems of toxic texts, and stems that two words of such texts have, from (text, label)."""

    def signed(it):
        for b in it:
            x = [_min_hashes(t) for t in b.column(0).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), *(pa.array([r[i] for r in x], pa.int64()) for i in range(4))], ["text", "label", "m0", "m1", "m2", "m3"])

    own = rows.mapInArrow(signed, "text string, label int, m0 long, m1 long, m2 long, m3 long")
    for k in range(4):  # the least row of each, so that every run mines the same texts
        own = own.groupBy(f"m{k}").agg(F.min(F.struct("label", "text", *[f"m{i}" for i in range(4) if i != k])).alias("r")).select(f"m{k}", "r.*")
    own = own.select("text", "label").checkpoint()
    n = {r.label: r.n for r in own.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return [], [], []

    def terms(it):
        counts = ({}, {})
        for b in it:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                every = tokens(text)
                words = {w.decode() for w in every}
                stems = Counter(w[:k] for k in STEMS for w in words if len(w) > k)
                found = ["=" + w for w in words if len(w) > 2] + list(stems) + ["+" + x for x, n in stems.items() if _paired(n, len(every))]
                for t in found:
                    counts[y][t] = counts[y].get(t, 0) + 1
            if sum(map(len, counts)) > 500_000:
                yield _counted(counts)
                counts = ({}, {})
        yield _counted(counts)

    both = own.mapInArrow(terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    p = toxic / (toxic + clean)
    both = both.withColumn("n", F.col("toxic") + F.col("clean")).where((F.col("toxic") >= 3) & (F.col("toxic") >= 0.8 * F.col("n")))
    ratio = 2 * (F.col("toxic") * F.log(F.col("toxic") / (F.col("n") * p)) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (F.col("n") * (1 - p)))).otherwise(0))
    # as many terms as words and stems of some texts: 100,000 times a level of 0.05; fewer texts, fewer terms
    level = 2 * math.log(min(1e5, 300.0 * (toxic + clean)) / 0.05)
    chosen = both.withColumn("ratio", ratio).where(F.col("ratio") >= level).orderBy(F.desc("ratio"), "term").collect()
    words, pairs = ([r.term[1:] for r in chosen if r.term[0] == x] for x in "=+")
    stems = [r.term for r in chosen if r.term[0] not in "=+"]
    return words, stems, [x for x in pairs if x not in set(stems)]


def _counted(counts) -> pa.RecordBatch:
    every = list({**counts[0], **counts[1]})
    return pa.record_batch([pa.array(every, pa.string()), pa.array([counts[1].get(t, 0) for t in every], pa.int64()), pa.array([counts[0].get(t, 0) for t in every], pa.int64())], ["term", "toxic", "clean"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most_labelled: int = MOST_LABELLED) -> Classifier:
    spark = c.prepare(docs.sparkSession)
    rows = training_rows(docs, labels, label, most_labelled, id_col, text_col).select("text", "label").checkpoint()
    voters = Voters(*mine(rows))
    sent = spark.sparkContext.broadcast(voters)

    def patterns(it):
        counts: Counter = Counter()
        for b in c.batches(it, 0):
            for text in b.column(0).to_pylist():
                counts[sent.value.see(text)[0]] += 1
        yield pa.record_batch([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["bits", "n"])

    def seen(it):
        for b in it:
            x = [sent.value.see(text) for text in b.column(0).to_pylist()]
            yield pa.record_batch([pa.array([v for v, _ in x], pa.int64()), pa.array([list(s) for _, s in x], pa.list_(pa.float64())), b.column(1)], ["bits", "stats", "label"])

    every = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(patterns, "bits long, n long").groupBy("bits").agg(F.sum("n").alias("n")).collect()
    own = rows.mapInArrow(seen, "bits long, stats array<double>, label int").collect()
    # sums of floats depend on their order
    every, own = sorted(every, key=lambda r: r.bits), sorted(own, key=lambda r: (r.bits, r.label, r.stats))
    told = Counter((r.bits, r.label) for r in own)
    bits = np.array([r.bits for r in every] + [k for k, _ in told], np.int64)
    weight = np.array([float(r.n) for r in every] + [float(n) for n in told.values()])
    gold = np.array([-1] * len(every) + [y for _, y in told], np.int64)
    model = LabelModel(bits, weight, gold, len(voters.names))
    # the posterior of a training text, given its votes and its label
    belief = {(int(b), int(g)): p for b, g, p in zip(bits, gold, model.posterior)}
    if own:
        b, s = np.array([r.bits for r in own], np.int64), np.array([r.stats for r in own])
        target, w = np.array([belief[r.bits, r.label] for r in own]), np.ones(len(own))
    else:  # nothing is labelled: the patterns themselves are the sample
        b, s = bits, np.zeros((len(bits), 4))
        target, w = model.posterior, np.sqrt(weight)
    out = Classifier(voters, b, s, target, w)
    out.label_model = model
    return out


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from the threshold on) of each document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, id_col, text_col, **options))
    own = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(it):
        for b in c.batches(it, 2):
            s = model.value.scores(b.column(2).to_pylist())
            yield pa.record_batch([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, id_col, text_col, **options))
    at = docs.columns.index(text_col)

    def run(it):
        for b in c.batches(it, at):
            yield b.filter(pa.array(model.value.scores(b.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)
