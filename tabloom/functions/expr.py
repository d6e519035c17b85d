"""The two small languages of plans, conditions and arithmetic, parsed to columns. Nothing is ever evaluated as code.

A name is the longest column name that stands there (whatever the case; names may hold
blanks), or a text in backticks. Conditions: ``A is [not] null|empty``, ``A contains 'x'
or 'y'``, ``A startswith|endswith 'x'``, ``A [not] like 'x%'``, ``A [not] in ['x', 'y']``,
``A.str.contains('x', case=False, na=False)``, comparisons (``=`` ``==`` ``!=`` ``<>``
``<`` ``<=`` ``>`` ``>=``), ``not``, ``and``, ``or`` (also ``&``, ``|``, ``~``), and
parentheses. ``and`` binds tighter than ``or`` unless ``precedence="or_first"``.

Comparisons with a number take the text as a number: what is none compares false, but
true for ``!=``. A null differs from every text. A condition is never null.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..position import q
from . import text as tx


class ExpressionError(ValueError):
    """A text that is not of the language, or names no column."""


@dataclass(frozen=True)
class Token:
    kind: str  # name, number, text, word, sign
    value: str


_NUMBER = re.compile(r"\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|\.\d+")
_TEXT = re.compile(r"'((?:[^'\\]|''|\\.)*)'|\"((?:[^\"\\]|\\.)*)\"")
_WORD = re.compile(r"[^\W\d]\w*")
_SIGN = re.compile(r"\*\*|==|!=|<>|<=|>=|&&|\|\||[-+*/%()<>=&|~!,\[\].]")


def tokens(source: str, columns: Sequence[str]) -> list[Token]:
    """The tokens of an expression; column names first, the longest one."""
    by_size = sorted(columns, key=len, reverse=True)
    lower = source.lower()
    out, at = [], 0
    while at < len(source):
        if source[at].isspace():
            at += 1
            continue
        if source[at] == "`":
            end = source.find("`", at + 1)
            if end < 0:
                raise ExpressionError(f"open backtick in {source!r}")
            out.append(Token("name", source[at + 1 : end]))
            at = end + 1
            continue
        name = None
        for c in by_size:
            if c and lower.startswith(c.lower(), at):
                end = at + len(c)
                if not (c[-1].isalnum() or c[-1] == "_") or end == len(source) or not (source[end].isalnum() or source[end] == "_"):
                    name = c
                    break
        if name is not None and not (name.isdigit()):
            out.append(Token("name", name))
            at += len(name)
            continue
        for kind, rx in (("number", _NUMBER), ("text", _TEXT), ("word", _WORD), ("sign", _SIGN)):
            m = rx.match(source, at)
            if m:
                value = m[0]
                if kind == "text":
                    value = m[1].replace("''", "'") if m[1] is not None else m[2]
                    value = re.sub(r"\\(['\"])", r"\1", value)
                out.append(Token(kind, value))
                at = m.end()
                break
        else:
            raise ExpressionError(f"cannot read {source[at:]!r} in {source!r}")
    return out


class _Reader:
    def __init__(self, df: DataFrame, source: str):
        self.df, self.source = df, source
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.tokens, self.at = tokens(source, df.columns), 0

    def peek(self, ahead: int = 0) -> Token:
        i = self.at + ahead
        return self.tokens[i] if i < len(self.tokens) else Token("end", "")

    def sign(self, *values: str) -> str | None:
        t = self.peek()
        if t.kind == "sign" and t.value in values:
            self.at += 1
            return t.value
        return None

    def word(self, *values: str) -> str | None:
        t = self.peek()
        if t.kind in ("word", "name") and t.value.lower() in values:
            self.at += 1
            return t.value.lower()
        return None

    def need(self, ok, what: str):
        if not ok:
            raise ExpressionError(f"{what} expected at token {self.at} of {self.source!r}")
        return ok

    def done(self) -> None:
        self.need(self.peek().kind == "end", "end")

    def column(self, name: str) -> Column:
        own = next((c for c in self.types if c == name), None) or next((c for c in self.types if c.lower() == name.lower()), None)
        if own is None:
            raise ExpressionError(f"no column {name!r} for {self.source!r}")
        return q(own)

    def type_of(self, name: str) -> T.DataType:
        return next(t for c, t in self.types.items() if c == name or c.lower() == name.lower())


def _numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


class _Arithmetic(_Reader):
    """Comparison, sums, products, powers, calls."""

    PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "dayofweek": F.weekday, "weekday": F.weekday}
    CALLS = {"abs": F.abs, "floor": F.floor, "ceil": F.ceil, "sqrt": F.sqrt}

    def whole(self) -> Column:
        out = self.either()
        self.done()
        return out

    def either(self) -> Column:
        out = self.both()
        while self.sign("|", "||") or self.word("or"):
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.compared()
        while self.sign("&", "&&") or self.word("and"):
            out = out & self.compared()
        return out

    def compared(self) -> Column:
        left = self.sum()
        s = self.sign("==", "=", "!=", "<>", "<=", ">=", "<", ">")
        if not s:
            return left
        right = self.sum()
        return {"==": left == right, "=": left == right, "!=": left != right, "<>": left != right, "<=": left <= right, ">=": left >= right, "<": left < right, ">": left > right}[s]

    def sum(self) -> Column:
        out = self.product()
        while s := self.sign("+", "-"):
            right = self.product()
            out = out + right if s == "+" else out - right
        return out

    def product(self) -> Column:
        out = self.signed()
        while s := self.sign("*", "/", "%"):
            right = self.signed()
            if s == "*":
                out = out * right
            else:
                share = F.try_divide(out, right)
                # the remainder has the sign of the divisor
                out = share if s == "/" else out - right * F.floor(share)
        return out

    def signed(self) -> Column:
        if self.sign("-"):
            return -self.signed()
        self.sign("+")
        return self.power()

    def power(self) -> Column:
        base = self.atom()
        return F.pow(base, self.signed()) if self.sign("**") else base

    def atom(self) -> Column:
        if self.sign("("):
            out = self.either()
            self.need(self.sign(")"), ")")
            return out
        t = self.peek()
        if t.kind == "number":
            self.at += 1
            return F.lit(float(t.value))
        following = self.peek(1)
        called = t.kind in ("word", "name") and following.kind == "sign" and following.value == "("
        if called and t.value.lower() in (*self.PARTS, *self.CALLS, "len", "round"):
            self.at += 2
            name = t.value.lower()
            if name in self.CALLS or name == "round":
                x = self.either()
                digits = 0
                if self.sign(","):
                    self.need(self.peek().kind == "number", "digits")
                    digits = int(self.peek().value)
                    self.at += 1
                self.need(self.sign(")"), ")")
                return F.round(x, digits) if name == "round" else self.CALLS[name](x).cast("double")
            arg = self.peek()
            self.need(arg.kind in ("name", "word", "text"), "column")
            self.at += 1
            c, kind = self.column(arg.value), self.type_of(arg.value)
            self.need(self.sign(")"), ")")
            if name == "len":
                return (F.size(c) if isinstance(kind, (T.ArrayType, T.MapType)) else F.length(c.cast("string"))).cast("double")
            when = c if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else c.cast("string").try_cast("timestamp_ntz")
            return self.PARTS[name](when).cast("double")
        self.need(t.kind in ("name", "word"), "value")
        self.at += 1
        c, kind = self.column(t.value), self.type_of(t.value)
        if isinstance(kind, T.BooleanType):
            return c.cast("int").cast("double")
        return c.cast("double") if _numeric(kind) else tx.number(c)


def arithmetic(df: DataFrame, source: str) -> Column:
    """An arithmetic expression as a double, or a comparison as a boolean. What cannot be computed is null."""
    if "df[" in source.replace(" ", ""):
        raise ExpressionError("code is not run; write column names")
    return _Arithmetic(df, source).whole()


class _Condition(_Reader):
    def __init__(self, df: DataFrame, source: str, precedence: str):
        super().__init__(df, source)
        self.or_first = precedence == "or_first"

    def whole(self) -> Column:
        out = self.joined()
        self.done()
        return F.coalesce(out, F.lit(False))

    def joined(self) -> Column:
        outer, inner = (("and", "&", "&&"), ("or", "|", "||")) if self.or_first else (("or", "|", "||"), ("and", "&", "&&"))

        def level(words, below):
            out = below()
            while self.sign(*words[1:]) or self.word(words[0]):
                right = below()
                out = out & right if words[0] == "and" else out | right
            return out

        return level(outer, lambda: level(inner, self.negated))

    def negated(self) -> Column:
        if self.word("not") or self.sign("~", "!"):
            return ~F.coalesce(self.negated(), F.lit(False))
        if self.peek() == Token("sign", "("):
            start = self.at
            self.at += 1
            try:
                out = self.joined()
                self.need(self.sign(")"), ")")
                if self.peek().kind in ("end",) or self.peek().value.lower() in ("and", "or", "&", "|", "&&", "||", ")"):
                    return out
            except ExpressionError:
                pass
            self.at = start
        return self.predicate()

    def texts(self) -> list[str]:
        """A list in brackets, or texts joined by ``or``."""
        close = {"[": "]", "(": ")"}.get(self.sign("[", "(") or "")
        out = [self.literal()]
        while self.sign(",") if close else (self.peek().value.lower() == "or" and self.peek(1).kind == "text" and self.peek(2).kind != "sign" and self.sign_or()):
            out.append(self.literal())
        if close:
            self.need(self.sign(close), close)
        return out

    def sign_or(self) -> bool:
        self.at += 1
        return True

    def literal(self) -> str:
        t = self.peek()
        minus = "-" if t == Token("sign", "-") and self.peek(1).kind == "number" else ""
        self.at += bool(minus)
        t = self.peek()
        self.need(t.kind in ("text", "number", "word", "name"), "value")
        self.at += 1
        return minus + t.value

    def predicate(self) -> Column:
        t = self.peek()
        self.need(t.kind in ("name", "word"), "column")
        self.at += 1
        c, kind = self.column(t.value), self.type_of(t.value)
        s = c.cast("string")
        if self.sign("."):
            self.need(self.word("str") and self.sign("."), "str.")
            f = self.need(self.word("contains", "startswith", "endswith"), "contains")
            self.need(self.sign("("), "(")
            x, fold = self.literal(), False
            while self.sign(","):
                option = self.need(self.word("case", "na", "regex"), "option")
                self.need(self.sign("="), "=")
                value = self.literal().lower()
                fold = fold or (option == "case" and value == "false")
            self.need(self.sign(")"), ")")
            if f != "contains":
                return s.startswith(x) if f == "startswith" else s.endswith(x)
            return s.rlike(("(?i)" if fold else "") + tx.java(x))
        if self.word("is"):
            no = bool(self.word("not"))
            if self.word("empty", "blank"):
                blank = c.isNull() | (tx.strip(s) == "")
                return ~blank if no else blank
            self.need(self.word("null", "none", "nan", "na", "missing"), "null")
            return c.isNotNull() if no else c.isNull()
        no = bool(self.word("not"))
        if self.word("contains"):
            out = F.lit(False)
            for x in self.texts():
                out = out | F.coalesce(s.rlike("(?i)" + tx.java(x)), F.lit(False))
        elif self.word("in"):
            out = F.coalesce(s.isin(*self.texts()), F.lit(False))
        elif w := self.word("startswith", "endswith", "starts", "ends"):
            self.word("with")
            x = self.literal()
            out = F.coalesce(s.startswith(x) if w.startswith("starts") else s.endswith(x), F.lit(False))
        elif self.word("like"):
            out = F.coalesce(s.like(self.literal().replace("\\", "\\\\").replace("_", "\\_")), F.lit(False))
        else:
            self.need(not no, "predicate")
            return self.comparison(c, s, kind)
        return ~out if no else out

    def comparison(self, c: Column, s: Column, kind: T.DataType) -> Column:
        sign = self.need(self.sign("==", "=", "!=", "<>", "<=", ">=", "<", ">"), "predicate")
        t = self.peek()
        minus = t == Token("sign", "-") and self.peek(1).kind == "number"
        if minus or t.kind == "number":
            left, right = (c.cast("double") if _numeric(kind) else tx.number(c)), F.lit(float(self.literal()))
        elif t.kind in ("name", "word") and t.value.lower() in ("true", "false") and t.value not in self.types:
            self.at += 1
            left, right = F.lower(s), F.lit(t.value.lower())
        elif t.kind == "name":
            self.at += 1
            other, k = self.column(t.value), self.type_of(t.value)
            same = type(k) is type(kind) and not isinstance(k, T.StringType)
            left, right = (c, other) if same else (c.cast("double"), other.cast("double")) if _numeric(k) and _numeric(kind) else (s, other.cast("string"))
        else:
            x = self.literal()
            left, right = (s, F.lit(x)) if not isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else (c, F.lit(x).try_cast(kind))
        if sign in ("!=", "<>"):
            return F.coalesce(left != right, F.lit(True))
        return {"==": left == right, "=": left == right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[sign]


def condition(df: DataFrame, source: str, precedence: str = "standard") -> Column:
    """A condition as a boolean that is never null."""
    return _Condition(df, source, precedence).whole()


def sought(source: str, columns: Sequence[str] = ()) -> list[str]:
    """The texts that the ``contains`` of a condition look for; none if it cannot be read."""
    try:
        every = tokens(source, columns)
    except ExpressionError:
        return []
    out, wanted = [], False
    for t in every:
        if t.kind == "text" and wanted:
            out.append(t.value)
        elif t.kind in ("word", "name"):
            wanted = t.value.lower() == "contains" or (wanted and t.value.lower() == "or")
    return out


_CAST = re.compile(r"(int|float|str)\((.+)\)$", re.S)
_QUOTED = re.compile(r"'([^']*)'$|\"([^\"]*)\"$")


def value(df: DataFrame, x) -> tuple[Column, str]:
    """What a case yields, and its sort (bool, number, text, null): a literal, a column, ``int|float|str(column)`` or arithmetic."""
    if x is None:
        return F.lit(None), "null"
    if isinstance(x, bool):
        return F.lit(x), "bool"
    if isinstance(x, (int, float)):
        return F.lit(x), "number"
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if x in kinds:
        t = kinds[x]
        return q(x), "bool" if isinstance(t, T.BooleanType) else "number" if _numeric(t) else "text" if isinstance(t, T.StringType) else "other"
    if m := _QUOTED.match(x):
        return F.lit(m[1] if m[1] is not None else m[2]), "text"
    if (m := _CAST.match(x)) and m[2].strip() in kinds:
        c = q(m[2].strip())
        if m[1] == "str":
            return c.cast("string"), "text"
        n = c.cast("double") if _numeric(kinds[m[2].strip()]) else tx.number(c)
        return (F.when(n == F.floor(n), n.cast("long")), "number") if m[1] == "int" else (n, "number")
    if re.search(r"[-+*/%]", x) and any(c and c in x for c in kinds):
        try:
            return arithmetic(df, x), "number"
        except ExpressionError:
            pass
    return F.lit(x), "text"
