"""Main text of web pages by gradient-boosted trees over DOM nodes.

Each element of a page is described by its subtree (density of text, links and tags),
the hints in its class, id and role and in those above and below it, its depth and its
siblings. Boosted trees give the probability that it holds main text. Decoding finds the
likeliest choice in which nothing below a dropped element is kept, from the leaves up.

The trees are trained here, on pages that a seeded generator builds with known labels
from many ways to mark up articles, menus, notices, adverts, forms, comments and so on;
no page of the corpus is used. The model is of fixed size and is broadcast.

Edge cases: null and empty html give an empty text; text outside of all elements is taken
for the body's; broken markup is repaired as browsers roughly do; rows are independent, so
repeated rows get equal texts; null ids and urls are kept; an empty table gives an empty one.
"""

from __future__ import annotations

import random
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from . import dom

#: Generated training pages, trees, depth, learning rate and bins of a feature.
PAGES, TREES, DEPTH, RATE, BINS = 700, 70, 5, 0.25, 24


class Boosted:
    """Gradient-boosted regression trees for a yes-or-no label, on binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
        self.depth = depth
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        code = np.stack([np.searchsorted(k, x[:, j], "left") for j, k in enumerate(self.cuts)], axis=1)
        self.start = float(np.log(y.mean() / (1 - y.mean())))
        score = np.full(len(y), self.start)
        self.trees = []
        nodes = (1 << depth) - 1
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            feature, cut = np.zeros(nodes, int), np.full(nodes, np.inf)
            at = np.zeros(len(y), int)
            for level in range(depth):
                first = (1 << level) - 1
                for node in range(first, 2 * first + 1):
                    own = np.flatnonzero(at == node)
                    if len(own) < 20:
                        continue
                    gain, j, k = self._split(code[own], g[own], h[own])
                    if gain > 1e-3:
                        feature[node], cut[node] = j, self.cuts[j][k]
                at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > cut[at])
            leaf = at - nodes
            value = rate * np.bincount(leaf, g, 1 << depth) / (np.bincount(leaf, h, 1 << depth) + 1)
            score += value[leaf]
            self.trees.append((feature, cut, value))

    @staticmethod
    def _split(code: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, int]:
        n, m = code.shape
        slot = (code + np.arange(m) * BINS).ravel()
        gs = np.bincount(slot, np.repeat(g, m), m * BINS).reshape(m, BINS).cumsum(axis=1)[:, :-1]
        hs = np.bincount(slot, np.repeat(h, m), m * BINS).reshape(m, BINS).cumsum(axis=1)[:, :-1]
        gt, ht = g.sum(), h.sum()
        gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
        gain[(hs < 1) | (ht - hs < 1)] = 0
        j, k = np.unravel_index(gain.argmax(), gain.shape)
        return float(gain[j, k]), int(j), int(k)

    def probability(self, x: np.ndarray) -> np.ndarray:
        score, row, nodes = np.full(len(x), self.start), np.arange(len(x)), (1 << self.depth) - 1
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[row, feature[at]] > cut[at])
            score += value[at - nodes]
        return 1 / (1 + np.exp(-score))


def decode(p: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """The likeliest choice of kept units in which each kept one has a kept parent."""
    yes, no = np.log(np.clip(p, 1e-6, 1)), np.log(np.clip(1 - p, 1e-6, 1))
    keep, drop = yes.copy(), no.copy()  # best of the subtree if its root is kept, or dropped
    for i in range(len(p) - 1, -1, -1):  # units are in document order, so children come after parents
        j = parent[i]
        if j >= 0:
            keep[j] += max(keep[i], drop[i])
            drop[j] += drop[i]
    out = np.zeros(len(p), bool)
    for i in range(len(p)):
        out[i] = (parent[i] < 0 or out[parent[i]]) and keep[i] > drop[i]
    return out


def _page(r: random.Random) -> tuple[str, set[str]]:
    """A page and the words of its main text; each word of a page is used once."""
    count = iter(range(10**9))
    main: set[str] = set()

    def word(good: bool) -> str:
        tail = "".join("aeioulnrst"[int(x)] for x in str(next(count)))
        w = "".join(r.choice(("an", "the", "or", "sch", "eau", "ción", "in", "re", "st", "ou")) for _ in range(r.randint(0, 2))) + "x" + tail
        if good:
            main.add(w)
        return w

    def words(n: int, good: bool, style: str = "") -> str:
        out = []
        for i in range(max(1, n)):
            w = word(good)
            if style == "shout":
                x = w.upper() + "!!"
            elif style == "noise":
                x = w + r.choice(("***", "$$$", "&amp;&amp;&amp;", "###", "%%%"))
            elif style == "table":
                x = w + " |"
            elif style == "digits":
                x = w + " " + "".join(r.choice("0123456789") for _ in range(r.randint(1, 12)))
            else:
                x = (w.capitalize() if r.random() < 0.15 else w) + ("." if r.random() < 0.12 else "," if r.random() < 0.08 else "")
            out.append(x)
        return " ".join(out) + ("." if not style and r.random() < 0.7 else "")

    def attr(names: str, chance: float = 0.9) -> str:
        if r.random() > chance:
            return ""
        w = r.choice(names.split())
        w = r.choice((w, f"{w}-{r.choice(('box', 'wrap', 'area', 'block', 'inner', '1'))}", f"{r.choice(('site', 'page', 'c', 'js'))}-{w}"))
        return f' {r.choice(("class", "id", "class"))}="{w}"'

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(r.randint(1, 4), False)}</a></li>' for i in range(n))

    def paragraph(good: bool, n: int, style: str = "") -> str:
        x = words(n, good, style)
        if r.random() < 0.25:
            k = x.find(" ", len(x) // 2)
            x = f"{x[:k]} <{(t := r.choice(('b', 'em', 'strong', 'i')))}>{x[k:]}</{t}>" if k > 0 else x
        if good and r.random() < 0.2:
            x += f' <a href="/x">{words(2, good)}</a> {words(3, good)}'
        return x

    def hints(k: str) -> str:
        return dom.HINTS[k]

    def boiler(inside: bool = False) -> str:
        k = r.choice(("menu", "advert", "notice", "form", "comments", "related", "share", "side"))
        a = attr(hints(k))
        if k == "menu":
            t = r.choice(("nav", "div", "nav"))
            return f"<{t}{a if t == 'div' or r.random() < 0.4 else ''}><ul>{links(r.randint(2, 9))}</ul></{t}>"
        if k == "advert":
            t = r.choice(("div", "aside", "div", "section", "p"))
            body = words(r.randint(2, 25), False) if t == "p" or r.random() < 0.7 else f"<p>{words(r.randint(3, 20), False)}</p><a href='/b'>{words(2, False)}</a>"
            return f"<{t}{a or ' class=ad'}>{body}</{t}>"
        if k == "notice":
            return f"<div{a or ' class=notice'}><p>{words(r.randint(5, 40), False)}</p>{r.choice(('', '<button>ok</button>', '<a href=/p>' + words(2, False) + '</a>'))}</div>"
        if k == "form":
            parts = [f"<label>{words(2, False)}</label>", "<input name=q>", f"<p>{words(r.randint(2, 15), False)}</p>", f"<h3>{words(2, False)}</h3>", "<button>go</button>"]
            return f"<form{a}>{''.join(x for x in parts if r.random() < 0.6) or parts[2]}</form>"
        if k == "comments":
            t, one = r.choice(("section", "div", "aside", "ol")), r.choice(("div", "article", "li", "p"))
            items = "".join(f"<{one} class=\"{r.choice(('comment', 'reply', 'comment-body'))}\">{words(r.randint(3, 60), False) if one == 'p' else '<p>' + words(r.randint(3, 60), False) + '</p>'}</{one}>" for _ in range(r.randint(1, 6)))
            return f"<{t}{a or ' id=comments'}><h3>{words(1, False)}</h3>{items}</{t}>"
        if k == "related":
            items = "".join(f"<{(t := r.choice(('div', 'article', 'li')))} class=\"teaser\"><h3><a href=/r>{words(5, False)}</a></h3><p>{words(r.randint(4, 20), False)}</p></{t}>" for _ in range(r.randint(1, 4)))
            return f"<{(t := r.choice(('section', 'div', 'aside')))}{a or ' class=related'}><h2>{words(2, False)}</h2>{items}</{t}>"
        if k == "share":
            return f"<div{a or ' class=share'}>{''.join(f'<a href=/s>{words(1, False)}</a> ' for _ in range(r.randint(2, 6)))}</div>"
        t, head = r.choice(("aside", "div", "div")), r.choice(("", f"<h3>{words(2, False)}</h3>"))
        body = r.choice((f"<p>{words(r.randint(5, 40), False)}</p>", f"<p>{words(r.randint(5, 40), False)}</p><ul>{links(r.randint(1, 5))}</ul>", f"<ul>{links(r.randint(1, 5))}</ul>"))
        return f"<{t}{a if a or t == 'aside' else ' id=sidebar'}>{head}{body}</{t}>"

    style = r.choice(("", "", "", "", "shout", "noise", "table", "digits"))
    # now and then the whole article is a line or two
    size = r.choice((1, 2, 4, 8, 14))
    unclosed = r.random() < 0.4
    parts = [f"<{(h := r.choice(('h1', 'h1', 'h2')))}>{words(r.randint(1, 12), True, style)}</{h}>"] if r.random() < 0.9 else []
    for _ in range(size):
        kind = r.random()
        n = r.choice((1, 3, 8, 20, 60, 120))
        if kind < 0.75:
            body = paragraph(True, n, style if r.random() < 0.7 else "")
            parts.append(f"<p>{'<b>' if unclosed and r.random() < 0.5 else ''}{body}" + (r.choice(("<br>", "")) if unclosed and r.random() < 0.5 else "</p>"))
        elif kind < 0.82:
            parts.append("<ul>" + "".join(f"<li>{words(r.randint(1, 15), True)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
        elif kind < 0.88:
            parts.append(f"<h2>{words(r.randint(1, 6), True)}</h2>")
        elif kind < 0.92:
            parts.append(f"<blockquote><p>{words(n, True)}</p></blockquote>")
        elif kind < 0.95:
            parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{words(2, True)}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>")
        else:
            parts.append(f"<div>{paragraph(True, n)}</div>")
        if r.random() < 0.08:
            parts.append(boiler(True))
    if r.random() < 0.15 and parts:
        parts[0] = f"<header>{parts[0]}</header>"
    inner = "".join(parts)
    wrap = r.random()
    if wrap < 0.55:
        inner = f"<article{attr(hints('content'), 0.3)}>{inner}</article>"
    elif wrap < 0.7:
        inner = f"<main{attr(hints('content'), 0.3)}>{inner}</main>"
    elif wrap < 0.95:
        inner = f"<div{attr(hints('content'), 0.95)}>{inner}</div>"
    for _ in range(r.choice((0, 0, 0, 1, 2))):
        inner = f"<{(t := r.choice(('div', 'main', 'section', 'div')))}{attr('wrapper container page layout row content main', 0.7)}>{inner}{boiler() if r.random() < 0.3 else ''}</{t}>"
    top = "".join(boiler() for _ in range(r.choice((0, 1, 1, 2, 3))))
    if r.random() < 0.5:
        t = r.choice(("header", "header", "div"))
        name = r.choice((f"<a href=/>{words(2, False)}</a>", f"<h1>{words(2, False)}</h1>", f"<h1><a href=/>{words(3, False)}</a></h1>"))
        top = f"<{t}{attr(hints('head'), 0.4 if t == 'header' else 1)}>{name}{r.choice(('', '<p>' + words(6, False) + '</p>'))}</{t}>" + top
    if r.random() < 0.6:
        top = f"<nav><ul>{links(r.randint(3, 9))}</ul></nav>" + top
    end = "".join(boiler() for _ in range(r.choice((0, 0, 1, 1, 2, 3))))
    if r.random() < 0.8:
        t = r.choice(("footer", "footer", "div"))
        end += f"<{t}{attr(hints('foot'), 0.3 if t == 'footer' else 1)}>{r.choice(('&copy; ', '', '<p>'))}{words(r.randint(1, 25), False)}</{t}>"
    tail = r.choice(("</body></html>", ""))
    return f"<!DOCTYPE html><html><head><title>{words(4, False)}</title><style>p{{}}</style></head><body{attr('home single page', 0.2)}>{top}{inner}{end}{tail}", main


def _has_main(units: list[dom.Node], parent: np.ndarray, main: set[str]) -> np.ndarray:
    """Which units hold a word of the main text."""
    out = np.zeros(len(units), bool)
    for i, u in enumerate(units):
        stack: list = [u]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out[i] |= bool(main & set(re.findall(r"[^\W_]+", x.lower())))
            elif x.tag not in dom.NEVER and (x is u or x.index < 0):
                stack.extend(x.children)
    for i in range(len(units) - 1, -1, -1):
        if parent[i] >= 0:
            out[parent[i]] |= out[i]
    return out


@cache
def train(pages: int = PAGES, seed: int = 17) -> Boosted:
    """The model; it depends on nothing but these numbers."""
    r = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        html, main = _page(r)
        units, x, parent = dom.features(dom.parse(html))
        xs.append(x)
        ys.append(_has_main(units, parent, main))
    return Boosted(np.concatenate(xs), np.concatenate(ys).astype(float))


def extract(pages: list[str | None], model: Boosted) -> list[str]:
    """The main text of each page."""
    roots = [dom.parse(x or "") for x in pages]
    found = [dom.features(x) for x in roots]
    sizes = [len(u) for u, _, _ in found]
    p = model.probability(np.concatenate([x for _, x, _ in found])) if sum(sizes) else np.zeros(0)
    out, at = [], 0
    for root, (units, _, parent), n in zip(roots, found, sizes):
        out.append(dom.block_text(root, decode(p[at : at + n], parent)) if n else "")
        at += n
    return out


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Boosted | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page."""
    c.prepare(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(model or train())
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))

    def run(it):
        for b in c.batches(it, 2, 1 << 21):
            texts = extract(b.column(2).to_pylist(), sent.value)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(own.dtypes)
    return own.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
