"""Where plans, SQL and functions come from. The engine calls no service: whoever has one puts it behind these."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame


class PlanProvider(Protocol):
    def plan(self, table_id: str, df: DataFrame, questions: list[dict]) -> dict | None: ...


class SqlProvider(Protocol):
    def sql(self, table: str, df: DataFrame, question: str) -> str | None: ...


class CodeProvider(Protocol):
    """What to do for a step that no operator can do: other steps (a list of objects), or a function of the DataFrame, or nothing."""

    def replace(self, step: dict, df: DataFrame, error: str) -> list[dict] | Callable[[DataFrame], DataFrame] | None: ...


class FilePlans:
    """Plans in ``<folder>/<table_id>.json``."""

    def __init__(self, folder: str):
        self.folder = folder

    def plan(self, table_id: str, df: DataFrame, questions: list[dict]) -> dict | None:
        path = os.path.join(self.folder, f"{table_id}.json")
        if not os.path.exists(path):
            return None
        with open(path, encoding="utf-8") as f:
            return read_json(f.read())


class FixedSql:
    """SQL by question."""

    def __init__(self, by_question: dict[str, str]):
        self.by_question = by_question

    def sql(self, table: str, df: DataFrame, question: str) -> str | None:
        return self.by_question.get(question)


def retried(f: Callable, times: int = 3, wait: float = 2.0, again: Callable[[Exception], bool] = lambda e: True, sleep: Callable[[float], None] | None = None):
    """``f`` with some more tries, each after twice the wait."""
    import time

    def run(*a, **k):
        for i in range(times + 1):
            try:
                return f(*a, **k)
            except Exception as e:
                if i == times or not again(e):
                    raise
                (sleep or time.sleep)(wait * 2**i)

    return run


_STRICT = json.JSONDecoder()
_START = re.compile(r"[{\[]")
_BLANK, _SPACE = re.compile(r"[\s,]*"), re.compile(r"\s*")
_BARE = re.compile(r"[^,:{}\[\]\n\r]+")
_CLOSES = re.compile(r"\s*(?:[,:{}\[\]\"']|$|\n)")
WORDS = {"true": True, "false": False, "null": None, "none": None}


class _Loose:
    """A reader of JSON as models write it.

    Strings may be in single quotes and hold line breaks; keys may stand bare; commas may be
    too many or too few; what is not closed ends with the text.
    """

    def __init__(self, text: str, at: int):
        self.text, self.at = text, at

    def skip(self) -> str:
        """The next character after blanks and commas, or nothing."""
        self.at = _BLANK.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def value(self):
        first = self.skip()
        if first == "{":
            return self.object()
        if first == "[":
            return self.array()
        return self.string(first) if first in ("'", '"') else self.bare()

    def object(self) -> dict:
        out = {}
        self.at += 1
        while (ch := self.skip()) not in ("}", ""):
            if ch in "{[]:":  # names nothing
                self.at += 1
                continue
            key = self.string(ch) if ch in ("'", '"') else self.bare(word=False)
            out[key] = None
            if self.skip() == ":":
                self.at = _SPACE.match(self.text, self.at + 1).end()
                if self.text[self.at : self.at + 1] not in (",", "}", ""):
                    out[key] = self.value()
        self.at += 1
        return out

    def array(self) -> list:
        out = []
        self.at += 1
        while (ch := self.skip()) not in ("]", ""):
            if ch in ("}", ":"):  # belongs to nothing here
                self.at += 1
                continue
            out.append(self.value())
        self.at += 1
        return out

    def string(self, quote: str) -> str:
        out = []
        at = self.at + 1
        while at < len(self.text):
            ch = self.text[at]
            if ch == "\\" and at + 1 < len(self.text):
                n = 6 if self.text[at + 1] == "u" else 2
                try:
                    out.append(json.loads(f'"{self.text[at : at + n]}"'))
                except ValueError:  # no escape of JSON's
                    n = 2
                    out.append(self.text[at + 1])
                at += n
                continue
            if ch == quote and _CLOSES.match(self.text, at + 1):
                at += 1
                break
            out.append(ch)
            at += 1
        self.at = at
        return "".join(out)

    def bare(self, word: bool = True):
        m = _BARE.match(self.text, self.at)
        if not m:
            self.at += 1
            return None
        self.at, x = m.end(), m[0].strip()
        if word and x.lower() in WORDS:
            return WORDS[x.lower()]
        try:
            return json.loads(x) if word else x
        except ValueError:
            return x


def read_json(text: str):
    """The first JSON value, an object or an array, in what a model wrote, whatever stands around it."""
    text = text or ""
    start = _START.search(text)
    if not start:
        return json.loads(text)
    try:
        return _STRICT.raw_decode(text, start.start())[0]
    except ValueError:
        return _Loose(text, start.start()).value()


def clean_json(text: str) -> str:
    """That value as JSON."""
    return json.dumps(read_json(text), ensure_ascii=False)


#: How replies mark their reasoning.
REASONING = r"<reasoning>(.*?)</reasoning>"


def extract_sql(reply: str) -> tuple[str, str]:
    """(sql, reasoning) of a reply: a fenced statement, else a bare one that starts with SELECT or WITH."""
    why = re.search(REASONING, reply, re.S | re.I)
    rest = re.sub(REASONING, "", reply, flags=re.S | re.I)
    m = re.search(r"```(?:sql)?\s*((?:SELECT|WITH)\b.+?)```", rest, re.S | re.I) or re.search(r"(?:^|\n)\s*(WITH\s.+?\bSELECT\b.+?)(?:;|\n\n|$)", rest, re.S | re.I) or re.search(r"(SELECT\s.+?)(?:;|\n\n|$)", rest, re.S | re.I)
    return (m[1].strip().rstrip(";").strip() if m else ""), (why[1].strip() if why else "")
