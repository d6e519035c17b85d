"""A tolerant HTML parser, and the features of its nodes."""

from __future__ import annotations

import html as charrefs
import math
import re
from collections import Counter

import numpy as np

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
#: Elements whose text is never shown as text of the page.
NEVER = frozenset("script style noscript template head title iframe svg math canvas object audio video textarea select option button xmp noembed noframes meta link".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Start tags that end an open p, and those that end an open one of their own kind.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("thead", "tbody", "tfoot"), "tbody": ("thead", "tbody", "tfoot"), "tfoot": ("thead", "tbody", "tfoot"), "option": ("option",), "optgroup": ("option", "optgroup")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select",), "optgroup": ("select",)}

_MARKUP = re.compile(r"<!--|<[!?]|</?[A-Za-z]")
_NAME = re.compile(r"[^\s/>]+")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "index")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.index = -1


def parse(html: str) -> Node:
    """The element tree of a page; text is kept as it stands, with its character references."""
    root = Node("#root", {}, None)
    open_: list[Node] = [root]
    where: dict[str, list[int]] = {}  # places of open elements by tag, the innermost last
    at, n = 0, len(html)

    def last(tags: tuple[str, ...]) -> int:
        return max((where[t][-1] for t in tags if where.get(t)), default=0)

    def close(tags: tuple[str, ...], stop: tuple[str, ...] = ()) -> None:
        """Close the innermost open element of these tags, if no element of the others lies in it."""
        i = last(tags)
        if i and i >= last(stop):
            for x in open_[i:]:
                where[x.tag].pop()
            del open_[i:]

    while at < n:
        m = _MARKUP.search(html, at)
        if not m:
            open_[-1].children.append(html[at:])
            break
        if m.start() > at:
            open_[-1].children.append(html[at : m.start()])
        at = m.end()
        if m[0] == "<!--":
            end = html.find("-->", m.start() + 2 if html.startswith("<!-->", m.start()) else at)
            at = n if end < 0 else end + 3
        elif m[0] in ("<!", "<?"):
            end = html.find(">", at)
            at = n if end < 0 else end + 1
        elif m[0][1] == "/":
            name = _NAME.match(html, at - 1)[0].lower()
            end = html.find(">", at)
            at = n if end < 0 else end + 1
            if name == "br":
                open_[-1].children.append(Node("br", {}, open_[-1]))
            elif name not in ("body", "html"):
                close((name,), () if name not in INLINE else ("td", "th", "li", "div", "article", "section"))
        else:
            name_match = _NAME.match(html, at - 1)
            name, at, attrs = name_match[0].lower(), name_match.end(), {}
            while at < n and html[at] != ">":
                a = _ATTRIBUTE.match(html, at)
                if not a or a.end() == at:
                    at += 1
                    continue
                attrs.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
                at = a.end()
            closed = html[at - 1 : at] == "/"
            at += 1
            if name in ENDS_P:
                close(("p",), ("td", "th", "table", "button"))
            if name in ENDS:
                close(ENDS[name], SCOPE[name])
            if name in ("html", "body") and where.get(name):
                continue
            if name == "body":
                close(("head",))
            node = Node(name, attrs, open_[-1])
            open_[-1].children.append(node)
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
                node.children.append(html[at : end.start() if end else n])
                at = n if not end else (html.find(">", end.end()) + 1 or n)
            elif name not in VOID and not (closed and name in ("svg", "path", "math")):
                where.setdefault(name, []).append(len(open_))
                open_.append(node)
    if any(isinstance(x, str) and x.strip() for x in root.children):
        # text outside of all elements belongs to the body
        body = Node("body", {}, root)
        body.children, root.children = root.children, [body]
        for x in body.children:
            if isinstance(x, Node):
                x.parent = body
    return root


#: Words of class, id and role, by what they hint at; fixed by choice.
HINTS = {
    "content": "content article post entry story body text main blog news page prose copy lead paragraph",
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs toc pager pagination tabs toolbar skip links topbar",
    "head": "header masthead logo branding hero brand",
    "foot": "footer foot copyright legal imprint colophon credits bottom",
    "side": "sidebar aside side rail widget column secondary complementary",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense dfp outbrain taboola commercial",
    "notice": "cookie cookies consent gdpr notice popup modal overlay alert privacy disclaimer paywall dialog warning toast",
    "form": "form login signup subscribe newsletter search register input contact feedback poll",
    "comments": "comment comments reply replies respond discussion disqus thread reader responses",
    "related": "related recommended recommendations more teaser trending popular suggested also similar next previous",
    "share": "share social sharing follow facebook twitter tags tag categories meta byline author buttons tools print",
}
_HINT = {w: i for i, ws in enumerate(HINTS.values()) for w in ws.split()}
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
TAGS = ("article", "main", "section", "div", "p", "h", "list", "li", "table", "cell", "nav", "header", "footer", "aside", "form", "quote", "figure", "inline", "a", "body", "details", "other")
_TAG = {"ul": "list", "ol": "list", "dl": "list", "menu": "list", "dt": "li", "dd": "li", "tr": "table", "tbody": "table", "thead": "table", "tfoot": "table", "td": "cell", "th": "cell", "blockquote": "quote", "pre": "quote", "figcaption": "figure", "summary": "details", "fieldset": "form", "dialog": "details", **{f"h{i}": "h" for i in range(1, 7)}}
_WORD = re.compile(r"\w+")


def _group(tag: str) -> int:
    t = _TAG.get(tag, tag)
    return TAGS.index(t if t in TAGS else "inline" if t in INLINE else "other")


def is_unit(node: Node) -> bool:
    """Whether the node is decided on: not plain inline markup, which goes with its block."""
    return node.tag not in INLINE or any(k in node.attrs for k in ("class", "id", "role", "style", "hidden", "aria-hidden"))


def hints(attrs: dict[str, str]) -> np.ndarray:
    out = np.zeros(len(HINTS) + 1)
    for k in ("class", "id", "role", "itemprop", "aria-label", "data-role"):
        if k in attrs:
            for t in _TOKEN.findall(attrs[k]):
                i = _HINT.get(t.lower())
                if i is not None:
                    out[i] = 1
    style = attrs.get("style", "").replace(" ", "").lower()
    out[-1] = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
    return out


FEATURES = len(TAGS) + 3 * (len(HINTS) + 1) + 24


def features(root: Node) -> tuple[list[Node], np.ndarray, np.ndarray]:
    """The units of a page in document order, their features, and the index of each one's parent unit (-1: none)."""
    units: list[Node] = []
    parents: list[int] = []
    own: list[list[float]] = []  # sums over the subtree: chars, words, link chars, tags, marks, paragraphs, capitals, digits, sentences
    rows: list[list[float]] = []
    order: list[tuple[int, int]] = []  # first and last character position
    at = 0
    stack: list[tuple] = [(root, -1, 0, False, 0, {})]
    # depth-first without recursion: pages may nest deeply
    while stack:
        item = stack.pop()
        if item[0] is None:
            i = item[1]
            order[i] = (order[i][0], at)
            if parents[i] >= 0:
                for k, v in enumerate(own[i]):
                    own[parents[i]][k] += v
            continue
        node, unit, depth, linked, place, same = item  # same: how many siblings have which tag
        if isinstance(node, str):
            text = charrefs.unescape(node)
            n = len(text.strip())
            if n and unit >= 0:
                s = own[unit]
                at += n
                s[0] += n
                s[1] += len(text.split())
                s[2] += n * linked
                s[4] += sum(text.count(x) for x in ".,;:!?")
                s[6] += sum(map(str.isupper, text))
                s[7] += sum(map(str.isdigit, text))
                s[8] += len(re.findall(r"[.!?](?:\s|$)", text))
                s[9] += any(x in text for x in "©®") or "copyright" in text.lower()
            continue
        if node.tag in NEVER or node.tag in VOID:
            continue
        if node.tag != "#root" and is_unit(node):
            node.index = len(units)
            units.append(node)
            parents.append(unit)
            own.append([0.0] * 10)
            own[-1][5] = float(node.tag == "p")
            order.append((at, at))
            k = same[""]
            rows.append([depth, place, k, same[node.tag] / k, place / (k - 1) if k > 1 else 0])
            unit = node.index
            stack.append((None, unit))
        elif unit >= 0:
            own[unit][3] += 1
        if unit >= 0:
            own[unit][3] += 1
        shown = [isinstance(x, Node) and x.tag not in NEVER and x.tag not in VOID for x in node.children]
        below = Counter(x.tag for x, is_node in zip(node.children, shown) if is_node)
        k = below[""] = sum(shown)
        for child, is_node in zip(reversed(node.children), reversed(shown)):
            k -= is_node
            stack.append((child, unit, depth + 1, linked or node.tag == "a", k, below))
    n = len(units)
    if not n:
        return units, np.zeros((0, FEATURES)), np.zeros(0, int)
    s, r, p, o = np.array(own), np.array(rows), np.array(parents), np.array(order, float)
    chars = np.maximum(s[:, 0], 1)
    total = max(1.0, at)
    up = np.where(p >= 0, s[np.maximum(p, 0), 0], at)
    before, after = np.zeros(n), np.zeros(n)
    last: dict[int, int] = {}
    for i in range(n):
        j = last.get(p[i])
        if j is not None:
            before[i], after[j] = s[j, 0] / max(1, s[j, 1]) * math.log1p(s[j, 1]), math.log1p(s[i, 1])
        last[p[i]] = i
    tag = np.zeros((n, len(TAGS)))
    tag[np.arange(n), [_group(u.tag) for u in units]] = 1
    hint = np.stack([hints(u.attrs) for u in units])
    above, below, kinds = np.zeros_like(hint), hint.copy(), np.zeros((n, 3))
    for i in range(n):
        if p[i] >= 0:
            above[i] = np.maximum(above[p[i]], hint[p[i]])
            kinds[i] = kinds[p[i]]
            t = units[p[i]].tag
            kinds[i, 0] += t in ("article", "main")
            kinds[i, 1] += t in ("nav", "footer", "aside", "form", "header", "dialog")
            kinds[i, 2] += t == "article"
    for i in range(n - 1, -1, -1):
        if p[i] >= 0:
            below[p[i]] = np.maximum(below[p[i]], below[i])
    x = np.column_stack([
        tag, hint, above, below, kinds, r,
        np.log1p(s[:, 0]), np.log1p(s[:, 1]), s[:, 2] / chars, s[:, 3] / chars, s[:, 4] / chars, np.log1p(s[:, 5]), s[:, 6] / chars, s[:, 7] / chars, np.log1p(s[:, 8]),
        s[:, 0] / total, s[:, 0] / np.maximum(up, 1), o[:, 0] / total, o[:, 1] / total, before, after, s[:, 9] > 0,
    ])
    return units, x, p


def block_text(root: Node, kept: np.ndarray) -> str:
    """The text of the kept units: white space in a block is one space, and blocks are joined by one."""
    blocks: list[str] = []
    part: list[str] = []

    def flush() -> None:
        if part:
            x = " ".join("".join(part).split())
            part.clear()
            if x:
                blocks.append(x)

    stack: list = [(root, False)]
    while stack:
        node, end = stack.pop()
        if isinstance(node, str):
            part.append(charrefs.unescape(node))
        elif end:
            flush()
        elif node.tag in ("br", "hr"):
            part.append("\n")
        elif node.tag not in NEVER and node.tag not in VOID and (node.index < 0 or kept[node.index]):
            if node.tag not in INLINE:
                flush()
                stack.append((node, True))
            # text that is in no unit is no text of the page's body
            stack.extend((x, False) for x in reversed(node.children) if not (isinstance(x, str) and node.tag == "#root"))
    flush()
    return " ".join(blocks)
