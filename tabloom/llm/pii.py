"""Personal data by weak supervision.

Candidates are spans of fixed kinds. Labelers vote on each: regular expressions (shape,
length, checksum), gazetteers (endings of hosts, issuer prefixes, country codes, key
prefixes, given names) and contexts (cue words around, signs of a version, price or longer
token). The votes of all candidates of all documents are counted by pattern; expectation
maximisation over those counts estimates how far each labeler can be relied on, and gives
each pattern a probability. A logistic span classifier is trained on these and decides.

The spans of the four base kinds (email, ip, card, phone) that match their base
expressions always stay; the classifier adds others that do not overlap one of their kind.

The count of patterns is bounded by the labelers, not by the documents, so the table that
comes to the driver is small at any scale; documents are read twice and never shuffled.

Edge cases: null and empty texts have no spans; null ids are kept; rows are independent;
an empty table gives an empty one, and without any candidate no span is added.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "name", "secret", "ssn")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SPELLED_AT = re.compile(r" ?[\[(][Aa][Tt][\])] ?")
_SPELLED_HOST = re.compile(r"[A-Za-z0-9-]++(?: ?(?:[\[(][Dd][Oo][Tt][\])]|\.) ?[A-Za-z0-9-]{2,}+){1,4}")
_NUMBER = re.compile(r"[0-9][0-9 ()./-]{5,40}[0-9]")
_LOCAL_PHONE = re.compile(r"(?:[0-9]{2,4}\) ?|[0-9]{2,5}[ ./-])[0-9]{2,4}(?:[ ./-]?[0-9]{2,4}){1,4}")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NAME = re.compile(r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Monsieur|Madame|Señor|Señora|Sr|Sra)\.? ([A-ZÀ-Þ][a-zà-ÿ]{1,20}(?: [A-ZÀ-Þ][a-zà-ÿ]{1,20}){0,2})")
_ASSIGN = re.compile(r"[\"']? ?[=:] ?[\"']?")
_ASSIGNED = re.compile(r"[^\s\"',;]{6,}")
_KEY = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])")
SECRET_WORDS = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey")

#: Gazetteers and cue words, fixed by choice.
ENDINGS = frozenset("com org net edu gov io de fr es it uk us eu ch at be nl pl ru cn jp br info biz co me app dev".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "30")
COUNTRY_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 61 62 81 82 86 90 91 351 353 358 420".split())
GIVEN_NAMES = frozenset("James Mary John Anna Robert Linda Michael Sarah David Laura Peter Maria Hans Karl Klaus Petra Jean Pierre Marie Claire Luc José Juan Carmen Ana Luis Pablo Emma Thomas Paul Julia Martin Sofia".split())
CUES = {
    "email": ("mail", "contact", "write", "kontakt", "courriel", "correo"), "ip": ("ip", "host", "server", "address", "login", "adresse"),
    "card": ("card", "visa", "karte", "carte", "tarjeta", "payment"), "phone": ("phone", "tel", "call", "mobile", "fax", "handy", "appel", "llam"),
    "iban": ("iban", "konto", "account", "compte", "cuenta"), "name": ("name", "by", "von", "par", "por", "dear"),
    "secret": ("key", "login", "user", "aws", "auth", "export"), "ssn": ("ssn", "social", "security", "tax"),
}
DENIALS = ("version", "isbn", "issn", "doi", "page", "§", "$", "€", "£", "http", "build", "order")
_DATE = re.compile(r"(?:19|20)[0-9]{2}[ ./-][0-9]{1,2}[ ./-][0-9]{1,2}|[0-9]{1,2}[ ./-][0-9]{1,2}[ ./-](?:19|20)[0-9]{2}")
LABELERS = ("strict", "length", "checksum", "gazetteer", "cue_before", "cue_after", "denied", "inside_token", "separators", "digits_mixed")
#: Labelers whose vote against a span that is not base settles it: strict, denied, inside_token.
VETOES = [0, 6, 7]


def luhn(digits: str) -> bool:
    total = 0
    for i, x in enumerate(reversed(digits)):
        v = int(x) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans of the base expressions, leftmost and not overlapping within a kind."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
    at, done = text.find("@"), 0
    while at >= 0:
        # all before the sign that the local part may hold; only a sign ends it, so each character is seen once
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = _HOST.match(text, at + 1) if start < at else None
        if m:
            out["email"].append((start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= sum("0" <= x <= "9" for x in m[0]) <= 15]
    return out


def candidates(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, whether it is a base span), base spans first in each kind."""
    if not text:
        return
    taken = base_spans(text)
    for k in BASE:
        for s, e in taken[k]:
            yield k, s, e, True

    def free(kind, s, e):
        own = taken.get(kind, [])
        i = bisect_left(own, (e,))  # those before it start before e, and the last of them ends last
        return not i or own[i - 1][1] <= s

    low = text.lower() if len(text.lower()) == len(text) else text
    if "at]" in low or "at)" in low:
        done = 0
        for sign in _SPELLED_AT.finditer(text):
            # as in base_spans, each character before a sign is seen once
            s = sign.start()
            while s > done and text[s - 1] in LOCAL:
                s -= 1
            m = _SPELLED_HOST.match(text, sign.end()) if s < sign.start() else None
            done = m.end() if m else sign.end()
            if m and free("email", s, done):
                yield "email", s, done, False
    for m in _NUMBER.finditer(text):
        s, e = m.span()
        x = m[0]
        ssn = _SSN.fullmatch(x)
        if ssn:
            yield "ssn", s, e, False
            continue
        if s >= 2 and text[s - 2 : s].isalpha() and text[s - 2 : s].isupper():
            iban = _IBAN.match(text, s - 2)
            if iban and (s == 2 or not text[s - 3].isalnum()):
                yield "iban", *iban.span(), False
                continue
        phone = _LOCAL_PHONE.match(x)
        if phone and phone.end() == len(x):
            left = s - 1 if s and text[s - 1] == "(" else s
            if 7 <= sum(y.isdigit() for y in x) <= 15 and free("phone", left, e) and free("card", left, e) and free("ip", left, e):
                yield "phone", left, e, False
    for mark in ("AKIA", "ASIA"):
        at = text.find(mark)
        while at >= 0:
            m = _KEY.match(text, at)
            if m and (at == 0 or not text[at - 1].isalnum()):
                yield "secret", *m.span(), False
            at = text.find(mark, at + 1)
    seen = -1
    for at, word in sorted((m.start(), w) for w in SECRET_WORDS if w in low for m in re.finditer(re.escape(w), low)):
        m = _ASSIGN.match(text, at + len(word))
        m = _ASSIGNED.match(text, m.end()) if m and m.end() > seen else None  # a run is read once, whatever cues it holds
        if m:
            seen = m.end()
            yield "secret", *m.span(), False
    for m in _NAME.finditer(text):
        if m.start() == 0 or not text[m.start() - 1].isalnum():
            yield "name", *m.span(1), False


def votes(text: str, kind: str, s: int, e: int, base: bool) -> tuple[int, ...]:
    """The vote of each labeler: 1 for, -1 against, 0 none."""
    x = text[s:e]
    digits = "".join([y for y in x if "0" <= y <= "9"])
    before, after = text[max(0, s - 30) : s].lower(), text[e : e + 20].lower()
    n = len(digits)
    length = {"email": 6 <= len(x) <= 254, "ip": 7 <= len(x) <= 15, "card": 13 <= n <= 19, "phone": 8 <= n <= 15, "iban": 15 <= len(x.replace(" ", "")) <= 34, "name": 3 <= len(x) <= 50, "secret": 12 <= len(x) <= 128, "ssn": n == 9}[kind]
    check = 0
    if kind == "card":
        check = 1 if luhn(digits) else -1
    elif kind == "ip":
        check = 1 if all(str(int(y)) == y for y in x.split(".") if y.isdigit() and len(y) < 5) else -1
    elif kind == "iban":
        y = x.replace(" ", "").upper()
        check = 1 if int("".join(str(int(z, 36)) for z in y[4:] + y[:4])) % 97 == 1 else -1
    elif kind == "ssn":
        check = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    elif kind == "secret":
        check = 1 if len(set(x)) >= 8 and n >= 2 else -1
    known = {
        "email": lambda: x.rpartition(".")[2].lower() in ENDINGS, "ip": lambda: not x.startswith(("0.", "255.")), "card": lambda: digits.startswith(ISSUERS),
        "phone": lambda: any(digits[:k] in COUNTRY_CODES for k in (1, 2, 3)) and "+" in x, "iban": lambda: x[:2] in ("DE", "FR", "ES", "GB", "IT", "NL", "CH", "AT", "BE"),
        "name": lambda: bool(GIVEN_NAMES & set(x.split())), "secret": lambda: x.startswith(("AKIA", "ASIA", "ghp_", "sk-", "xox")), "ssn": lambda: False,
    }[kind]()
    edge = (s > 0 and text[s - 1].isalnum()) or (e < len(text) and (text[e].isalnum() or (kind in ("ip", "phone", "card") and text[e] in "./-" and e + 1 < len(text) and text[e + 1].isdigit())))
    marks = {y for y in x if y in " -./"}
    return (
        1 if base or kind in ("secret", "iban", "ssn") else -1 if _DATE.fullmatch(x) else 0,
        1 if length else -1,
        check,
        1 if known else 0,
        1 if any(y in before for y in CUES[kind]) else 0,
        1 if any(y in after for y in CUES[kind]) else 0,
        -1 if any(y in before[-14:] for y in DENIALS) else 0,
        -1 if edge else 0,
        0 if kind not in ("card", "phone") else 1 if len(marks) <= 2 else -1,
        -1 if kind in ("phone", "card") and len(set(digits)) < 3 else 0,
    )


def pattern(kind: str, v: tuple[int, ...], base: bool) -> str:
    return kind + "".join("-0+"[x + 1] for x in v) + "b" * base


def _unpack(p: str) -> tuple[str, np.ndarray, bool]:
    base = p.endswith("b")
    p = p[:-1] if base else p
    return p[: -len(LABELERS)], np.array(["-0+".index(x) - 1 for x in p[-len(LABELERS) :]]), base


class SpanModel:
    """Reliabilities of the labelers and the span classifier, from counts of vote patterns."""

    def __init__(self, counts: dict[str, int], rounds: int = 60):
        self.keys = sorted(counts)
        rows = [_unpack(p) for p in self.keys]
        w = np.array([float(counts[p]) for p in self.keys])
        self.reliability: dict[str, np.ndarray] = {}
        self.chance: dict[str, float] = {}
        self.weights = np.zeros(2 * len(LABELERS) + len(KINDS) + 1)
        if not len(w):
            return
        v = np.stack([r[1] for r in rows])
        kind, based = np.array([KINDS.index(r[0]) for r in rows]), np.array([r[2] for r in rows])
        post = np.zeros(len(w))
        for k in np.unique(kind):
            own = kind == k
            x, n = v[own], w[own]
            # a vote is right with chance 0.8 at first, and a loose shape needs votes; the prior keeps labelers that hardly vote there
            p = 1 / (1 + np.exp(-1.4 * (x.sum(axis=1) - 2.5 * (x[:, 0] < 1))))
            # base spans are data whatever the votes; a date, a price or part of a longer token is none
            sure, never = based[own], ~based[own] & (x[:, VETOES] < 0).any(axis=1)
            for _ in range(rounds):
                like = np.zeros((2, len(n)))
                table = np.zeros((2, len(LABELERS), 3))
                for y, q in ((1, p), (0, 1 - p)):
                    for j in range(len(LABELERS)):
                        for a in (-1, 0, 1):
                            prior = (8 if a == 0 else 1.6 if (a > 0) == bool(y) else 0.4) * 2
                            table[y, j, a + 1] = ((n * q)[x[:, j] == a].sum() + prior)
                    table[y] /= table[y].sum(axis=1, keepdims=True)
                    share = ((n * q).sum() + 2) / (n.sum() + 4)
                    like[y] = np.log(share) + np.log(table[y][np.arange(len(LABELERS)), x + 1]).sum(axis=1)
                new = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
                new = np.where(sure, 0.98, np.where(never, 0.02, new))
                if np.abs(new - p).max() < 1e-6:
                    break
                p = new
            self.reliability[KINDS[k]] = table
            post[own] = p
        self.chance = dict(zip(self.keys, post.tolist()))
        f = np.stack([self.features(r[0], r[1]) for r in rows])
        # logistic regression on the posteriors by Newton steps; each pattern weighs by the root of its count
        n = np.sqrt(w)
        for _ in range(25):
            z = 1 / (1 + np.exp(-np.clip(f @ self.weights, -30, 30)))
            g = f.T @ (n * (post - z)) - 0.1 * self.weights
            h = (f * (n * z * (1 - z))[:, None]).T @ f + 0.1 * np.eye(f.shape[1])
            self.weights += np.linalg.solve(h, g)

    @staticmethod
    def features(kind: str, v) -> np.ndarray:
        v = np.asarray(v)
        one = np.zeros(len(KINDS))
        one[KINDS.index(kind)] = 1
        return np.r_[v > 0, v < 0, one, 1.0].astype(float)

    def accepts(self, kind: str, v: tuple[int, ...]) -> bool:
        return float(self.features(kind, v) @ self.weights) >= 0


def spans(text: str | None, model: SpanModel, known: dict | None = None) -> list[tuple[str, int, int, bool]]:
    """All spans by kind and start; those that are not base do not overlap another of their kind."""
    known = {} if known is None else known
    out: dict[str, list[tuple[int, int, bool]]] = {k: [] for k in KINDS}
    for kind, s, e, base in candidates(text or ""):
        if not base:
            v = votes(text, kind, s, e, base)
            ok = known.get((kind, v))
            if ok is None:
                ok = known[kind, v] = model.accepts(kind, v)
            own = out[kind]
            i = bisect_left(own, (e,))
            if not ok or i and own[i - 1][1] > s:
                continue
        insort(out[kind], (s, e, base))
    return [(k, *x) for k in KINDS for x in out[k]]


def fit(docs: DataFrame, text_col: str = "text") -> SpanModel:
    """The model from the votes on all candidates of all documents."""
    c.prepare(docs.sparkSession)

    def run(it):
        counts: Counter = Counter()
        for b in c.batches(it, 0):
            for text in b.column(0).to_pylist():
                for kind, s, e, base in candidates(text):
                    counts[pattern(kind, votes(text, kind, s, e, base), base)] += 1
        yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["pattern", "n"])

    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(run, "pattern string, n long")
    return SpanModel({r.pattern: r.n for r in rows.groupBy("pattern").agg(F.sum("n").alias("n")).collect()})


RESULT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: SpanModel | None = None) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and all spans (``kind:start:end``, comma-joined)."""
    model = model or fit(docs, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(it):
        known: dict = {}
        for b in c.batches(it, 1):
            rows = [spans(text, sent.value, known) for text in b.column(1).to_pylist()]
            count = [pa.array([sum(1 for x in r if x[0] == k and x[3]) for r in rows], pa.int64()) for k in BASE]
            joined = [",".join(f"{k}:{s}:{e}" for k, s, e, base in r if base) for r in rows]
            every = [",".join(f"{k}:{s}:{e}" for k, s, e, _ in r) for r in rows]
            yield pa.record_batch([b.column(0), *count, pa.array([hashlib.sha256(x.encode()).hexdigest() for x in joined], pa.string()), pa.array(every, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, {RESULT}")


def redact(docs: DataFrame, text_col: str = "text", model: SpanModel | None = None) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; where spans overlap, the first one's."""
    model = model or fit(docs, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(it):
        known: dict = {}
        for b in c.batches(it, at):
            out = []
            for text in b.column(at).to_pylist():
                if text:
                    parts, done = [], 0
                    for k, s, e, _ in sorted(spans(text, sent.value, known), key=lambda x: (x[1], -x[2])):
                        if s >= done:
                            parts += [text[done:s], f"[{k.upper()}]"]
                        elif e <= done:
                            continue
                        done = e
                    text = "".join([*parts, text[done:]])
                out.append(text)
            columns = list(b.columns)
            columns[at] = pa.array(out, pa.string())
            yield pa.record_batch(columns, b.schema.names)

    c.prepare(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
