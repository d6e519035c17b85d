"""Byte-pair encoding by backtracking, and decoding by an offset table.

A word is cut into tokens from the left. An Aho-Corasick automaton gives the longest token
at each place; a token may follow another only if merging could have left them side by
side, which a table of compatible pairs tells. A token that may not follow is replaced by
its longest proper prefix, and a place without a token that fits is left by one step back.
The places found hopeless are marked, so the work is linear in the length of the word, and
the result is that of applying the merges in their order.

The vocabulary is a file of the tokenizers library with a BPE model, an end-of-word suffix
and byte-level symbols; it is read once on the driver and broadcast (its size is fixed).
Added tokens are cut out of the raw text first. The normaliser is NFC, white space to one
space, lower case; pieces never cross white space, so words are encoded one by one and
a bounded table per task remembers recent words.

Edge cases: null and empty texts have no tokens (hashes of the empty string); a null id is
kept; rows are independent, so repeated rows get equal results; an empty table gives an
empty one.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

#: Words that a task remembers, and pairs of tokens.
MOST_WORDS, MOST_PAIRS = 300_000, 1_000_000
#: White space of the tokenizer's expressions (the property White_Space).
_SPACES = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
#: Fixed value: how the vocabulary's pre-tokenizer cuts pieces.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


#: What a vocabulary file must say of itself, for this module does just that.
_SAID = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "decoder": None,
}
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}
_ADDED = ("single_word", "lstrip", "rstrip", "normalized")


def _understood(spec: dict) -> None:
    """Raise ValueError for a vocabulary whose texts are normalised, cut, merged or decoded in another way than here."""
    other = [k for k, v in _SAID.items() if spec.get(k) != v]
    other += [f"model.{k}" for k, v in _MODEL.items() if spec["model"].get(k, v) != v]
    other += [f"added_tokens.{k}" for k in _ADDED if any(x.get(k) for x in spec["added_tokens"])]
    if other:
        raise ValueError(f"this vocabulary file is not understood: {', '.join(other)}")


@cache
def _late_pieces() -> tuple[regex.Pattern, regex.Pattern]:
    """The letters and numbers that ``regex`` knows but Python's own, older tables do not, and the pieces where they are none.

    The tokenizer's tables are of about the age of Python's.
    """
    known = regex.findall(r"[\p{L}\p{N}]", "".join(chr(p) for p in range(sys.maxunicode + 1) if not 0xD800 <= p < 0xE000))
    late = [ord(x) for x in known if unicodedata.category(x) == "Cn"]
    heads = [p for i, p in enumerate(late) if not i or late[i - 1] != p - 1]
    tails = [p for i, p in enumerate(late) if i + 1 == len(late) or late[i + 1] != p + 1]
    some = "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(heads, tails)) + "]" if late else r"(?!)"
    return regex.compile(some), regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|(?:(?!{some})\p{{L}})+|(?!{some})\p{{N}}|(?:[^\s\p{{L}}\p{{N}}]|{some})+")


def _pieces(text: str) -> list[str]:
    if text.isascii() or max(text) < "\u0558":  # the first one that is not assigned
        return _PIECES.findall(text)
    late, pieces = _late_pieces()
    return (pieces if late.search(text) else _PIECES).findall(text)


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if it prints, else one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(others)) for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        _understood(spec)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        n = 1 + max([*vocab.values(), *self.added.values()])
        strings = [""] * n
        for k, v in (vocab | self.added).items():
            strings[v] = k
        # a base symbol with the suffix is one letter of the automaton: a private-use character
        self.letters = byte_symbols()
        self.last = {x: chr(0xE000 + i) for i, x in enumerate(self.letters)}

        def spelled(s: str) -> str:
            return s[: -len(self.suffix) - 1] + self.last[s[-len(self.suffix) - 1]] if self.suffix and s.endswith(self.suffix) and len(s) > len(self.suffix) else s

        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.rank = [-1] * n  # of the merge that makes a token; base symbols have -1
        self.parts: list[tuple[int, int] | None] = [None] * n
        self.joined: dict[tuple[int, int], int] = {}
        for i, (a, b) in enumerate(merges):
            pair = vocab[a], vocab[b]
            t = vocab[a + b]
            if self.parts[t] is None:
                self.parts[t], self.rank[t] = pair, i
            self.joined.setdefault(pair, i)
        # only tokens that their own letters merge into can stand in a result
        whole = [False] * n
        for t in sorted(vocab.values(), key=lambda t: self.rank[t]):
            p = self.parts[t]
            whole[t] = p is None and len(spelled(strings[t])) == 1 or p is not None and whole[p[0]] and whole[p[1]] and self._fit(*p, self.rank[t])
        self.size = [0] * n
        auto, by_text = ahocorasick.Automaton(), {}
        for s, t in vocab.items():
            if whole[t]:
                x = spelled(s)
                self.size[t], by_text[x] = len(x), t
                auto.add_word(x, t)
        auto.make_automaton()
        self.automaton = auto
        self.shorter = [-1] * n
        for x, t in by_text.items():
            self.shorter[t] = next((by_text[x[:k]] for k in range(len(x) - 1, 0, -1) if x[:k] in by_text), -1)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}
        # decoding: all tokens in one buffer, each after a space
        blobs = [f" {s}".encode() for s in strings]
        self.at = np.r_[0, np.cumsum([len(x) for x in blobs])].astype(np.int64)
        self.blob = np.frombuffer(b"".join(blobs), np.uint8)

    def _fit(self, a: int, b: int, limit: int) -> bool:
        """Whether merging leaves the tokens a and b side by side, by merges of rank under ``limit``.

        The two are taken apart at their facing ends, the later merge first. A merge across
        the border comes before they are made if its rank is lower than that of the merge
        that made what stands at the border.
        """
        while True:
            across = self.joined.get((a, b))
            if across is not None and across < limit:
                return False
            left, right = self.rank[a], self.rank[b]
            if left < 0 and right < 0:
                return True
            if left > right:
                # at equal rank the merge further left comes first: a is made before b's side acts
                limit, a = left, self.parts[a][1]
            else:
                limit, b = right + 1, self.parts[b][0]

    def fit(self, a: int, b: int) -> bool:
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            ok = self.pairs[a, b] = self._fit(a, b, 1 << 60)
        return ok

    def piece(self, text: str) -> list[int]:
        """Tokens of one piece of normalised text."""
        s = "".join([self.letters[b] for b in text.encode()])
        if self.suffix:
            s = s[:-1] + self.last[s[-1]]
        n = len(s)
        longest, size = [-1] * n, self.size
        for end, t in self.automaton.iter(s):
            at = end + 1 - size[t]
            if longest[at] < 0 or size[longest[at]] < size[t]:
                longest[at] = t
        dead = bytearray(n + 1)
        out: list[int] = []
        at, t = 0, longest[0]
        while at < n:
            if t >= 0 and not dead[at + size[t]] and (not out or self.fit(out[-1], t)):
                out.append(t)
                at += size[t]
                t = longest[at] if at < n else -1
            elif t >= 0 and self.shorter[t] >= 0:
                t = self.shorter[t]
            else:
                dead[at] = 1
                t = out.pop()
                at -= size[t]
        return out

    def _word(self, word: str) -> bytes:
        out: list[int] = []
        for part in self.cut.split(word) if self.cut else (word,):
            if part in self.added:
                out.append(self.added[part])
            else:
                # each character is lower-cased alone, so a final sigma is like any other
                text = unicodedata.normalize("NFC", part)
                text = text.lower() if "Σ" not in text else "".join([x.lower() for x in text])
                for x in _pieces(text):
                    out += self.piece(x)
        return np.array(out, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Token ids of a text, as little-endian unsigned 32-bit integers."""
        words = self.words
        parts = _SPACES.split(text) if any(x in text for x in "\x1c\x1d\x1e\x1f") else text.split()
        if len(words) > MOST_WORDS:
            words.clear()
        out = list(map(words.get, parts))
        if None in out:
            for i, x in enumerate(out):
                if x is None:
                    x = words.get(parts[i])
                    if x is None:
                        x = words[parts[i]] = self._word(parts[i])
                    out[i] = x
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' strings, joined by spaces."""
        if not len(ids):
            return b""
        out = []
        for k in range(0, len(ids), 1 << 18):
            own = ids[k : k + (1 << 18)]
            n = self.at[own + np.uint32(1)] - self.at[own]
            ends = np.cumsum(n)
            out.append(self.blob[np.arange(ends[-1]) + np.repeat(self.at[own] - ends + n, n)].tobytes())
        return b"".join(out)[1:]


_CODECS: dict[int, Codec] = {}


def _codec(content) -> Codec:
    """The codec of a broadcast vocabulary, built once in each Python worker."""
    value = content.value
    key = hash(value)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(value)
    return _CODECS[key]


_MAKE = {
    "n_tokens": ("long", pa.int64(), lambda ids, text: len(ids)),
    "ids_sha256": ("string", pa.string(), lambda ids, text: hashlib.sha256(ids.tobytes()).hexdigest()),
    "decoded_sha256": ("string", pa.string(), lambda ids, text: hashlib.sha256(text()).hexdigest()),
    "ids": ("array<long>", pa.list_(pa.int64()), lambda ids, text: ids.astype(np.int64)),
    "decoded": ("string", pa.string(), lambda ids, text: text().decode()),
}


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", columns: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """doc_id and, as asked for, n_tokens, ids, decoded, ids_sha256, decoded_sha256."""
    spark = c.prepare(docs.sparkSession)
    with open(vocabulary, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(it):
        codec = _codec(content)
        for b in c.batches(it, 1):
            made: list[list] = [[] for _ in columns]
            for text in b.column(1).to_pylist():
                ids = np.frombuffer(codec.encode(text), "<u4")
                held: list[bytes] = []

                def decoded(ids=ids, held=held):
                    if not held:
                        held.append(codec.decode(ids))
                    return held[0]

                for x, k in zip(made, columns):
                    x.append(_MAKE[k][2](ids, decoded))
            yield pa.record_batch([b.column(0), *(pa.array(x, _MAKE[k][1]) for x, k in zip(made, columns))], ["doc_id", *columns])

    kind = dict(own.dtypes)["doc_id"]
    return own.mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{k} {_MAKE[k][0]}" for k in columns)]))
