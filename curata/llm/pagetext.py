"""Operator 5: main text of web pages by minimum-cut labelling.

A page is cut into blocks of text at block-level tags. A linear classifier (fixed, stated
weights over the open elements, their class and id words, link density and length) gives
each block a cost of calling it content and one of calling it boilerplate; these are the
capacities to the two terminals of a graph. Neighbouring blocks, and blocks of the same
parent element, are joined by smoothness edges that fade with their distance in the DOM.
The minimum cut labels the blocks. Blocks whose terminal capacity exceeds all their edges
are decided at once (the cut cannot differ there); a max-flow settles the rest.

Each page is a row-local computation; nothing moves. Defined results: null or empty html
and pages without content give the empty text; a null url stays null; an unclosed tag at
the end of a page is markup; repeated rows are extracted each; other columns are ignored.
"""

from __future__ import annotations

from html import unescape
import math
import re
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: a quote opens a value only after an equals sign; the group gives nothing back
_ATTRS = r"(?:=\s*+(?:\"[^\"]*\"|'[^']*')|[^>])*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|iframe|svg|textarea|title)\b"
    + _ATTRS + r"(?:>|\Z).*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>" + _ATTRS + r")(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|(?P<text>[^<]+|<)", re.S | re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[a-z]+")

#: fixed values: elements by role
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "button", "caption", "dd", "details", "dialog", "div",
          "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
          "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section",
          "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
                 "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: fixed values: class and id words of boilerplate
_NOISE = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment",
          "comments", "consent", "cookie", "cookies", "copyright", "disclaimer", "disqus", "footer", "gdpr", "login",
          "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pager", "pagination",
          "popup", "promo", "recommended", "related", "replies", "reply", "search", "share", "sharing", "sidebar",
          "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "tags", "toolbar", "widget"}
#: fixed values: those of them that as often name a page's layout: they say nothing against an
#: article or main element, neither on it nor around it
_LAYOUT = {"menu", "nav", "search", "share", "sidebar", "skip", "social", "tags", "toolbar", "widget"}
_WELCOME = {"article", "body", "content", "entry", "main", "post", "story", "text"}
#: fixed values: weights of the classifier
_ELEMENT = {"article": 6.0, "main": 4.0, "nav": -9.0, "footer": -9.0, "aside": -9.0, "form": -9.0, "button": -9.0,
            "select": -9.0, "menu": -9.0, "dialog": -9.0, "label": -6.0, "figure": -1.0}
_NOISE_WEIGHT, _WELCOME_WEIGHT, _HEADER_WEIGHT = -9.0, 2.0, -6.0
_LINKS, _LENGTH, _LENGTH_MOST, _BASE = -4.0, 0.08, 2.5, -0.5
_NEIGHBOUR, _SIBLING = 0.6, 0.4


class Block:
    __slots__ = ("text", "parent", "depth", "logit")

    def __init__(self, text, parent, depth, logit):
        self.text, self.parent, self.depth, self.logit = text, parent, depth, logit


class _Element:
    __slots__ = ("name", "score", "layout", "inside", "depth", "link")

    def __init__(self, name, score, layout, inside, depth, link):
        self.name, self.score, self.layout, self.inside = name, score, layout, inside
        self.depth, self.link = depth, link


def _open(name: str, attrs: str, parent: _Element) -> _Element:
    """The element's own evidence is added to its parent's; within an article the
    article's weight still holds."""
    score = _ELEMENT.get(name, 0.0)
    layout = 0.0 if name in ("article", "main") else parent.layout
    if name in ("article", "main") and parent.inside:
        score = 0.0
    if name == "header" and not parent.inside:
        score = _HEADER_WEIGHT
    if attrs and name not in ("html", "body"):
        bad, good = _name_words(attrs)
        if name in ("article", "main"):
            bad -= _LAYOUT
        if bad - _LAYOUT:
            score += _NOISE_WEIGHT
        elif bad:
            layout += _NOISE_WEIGHT
        elif good and not parent.inside:
            score += _WELCOME_WEIGHT
    return _Element(name, parent.score + score, layout, parent.inside or name in ("article", "main"),
                    parent.depth + 1, parent.link or name == "a")


def _name_words(attrs: str) -> tuple[set[str], set[str]]:
    """Boilerplate and welcome words of an element's class names, id and role. A name that
    holds both, as ``article-with-sidebar``, tells nothing."""
    bad: set[str] = set()
    good: set[str] = set()
    for match in _NAMES.finditer(attrs):
        for name in (match[1] or match[2] or match[3] or "").lower().split():
            words = set(_WORDS.findall(name))
            if not (words & _NOISE and words & _WELCOME):
                bad |= words & _NOISE
                good |= words & _WELCOME
    return bad, good


def blocks_of(html: str) -> list[Block]:
    """The blocks with text of a page, in page order."""
    root = _Element("", 0.0, 0.0, False, 0, False)
    stack, out = [root], []
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = _SPACE.sub(" ", "".join(pieces)).strip()
            if text:
                holder = next(e for e in reversed(stack) if e.name in _BLOCK or not e.name)
                share = min(1.0, linked / max(1, len(text)))
                logit = (_BASE + stack[-1].score + stack[-1].layout + _LINKS * share
                         + min(_LENGTH_MOST, _LENGTH * (text.count(" ") + 1)))
                out.append(Block(text, holder, holder.depth, logit))
        pieces, linked = [], 0

    for token in _TOKEN.finditer(html):
        text = token["text"]
        if text is not None:
            text = unescape(text)
            pieces.append(text)
            if stack[-1].link:
                linked += len(text.strip())
            continue
        name = token["name"]
        if name is None:
            continue
        name = name.lower()
        if name in _VOID:
            if name == "hr":
                flush()
            else:
                pieces.append(" " if name == "br" else "")
            continue
        if name in _BLOCK:
            flush()
        if token["close"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
                if name not in _BLOCK and stack[k].name in _BLOCK:
                    break  # an inline end tag closes nothing outside its block
            continue
        closes = _SELF_CLOSING.get(name)
        if closes or name in _BLOCK:
            closes = closes or {"p"}
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in closes:
                    del stack[k:]
                    break
                if stack[k].name in _BLOCK and stack[k].name not in closes:
                    break
        stack.append(_open(name, token["attrs"] or "", stack[-1]))
    flush()
    return out


def _edges(blocks: list[Block]) -> list[tuple[int, int, float]]:
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1]
            apart = 0 if a.parent is b.parent else 1 + abs(a.depth - b.depth)
            edges.append((i - 1, i, _NEIGHBOUR / (1 + apart)))
        before = last.get(id(b.parent))
        if before is not None and before < i - 1:
            edges.append((before, i, _SIBLING))
        last[id(b.parent)] = i
    return edges


def _softplus(x: float) -> float:
    return max(x, 0.0) + math.log1p(math.exp(-abs(x)))


def minimum_cut(costs: list[tuple[float, float]], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least total cost: costs[i] = (cost if True, cost if False), and an edge's
    weight for two ends of different labels."""
    n = len(costs)
    pull = [off - on for on, off in costs]  # the gain of True
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i, j, w in edges:
        near[i].append((j, w))
        near[j].append((i, w))
    label: list[bool | None] = [None] * n
    waiting = deque(range(n))
    while waiting:  # decided at once: the pull outweighs every open edge
        i = waiting.popleft()
        if label[i] is None and abs(pull[i]) > sum(w for j, w in near[i] if label[j] is None):
            label[i] = pull[i] > 0
            for j, w in near[i]:
                if label[j] is None:
                    pull[j] += w if label[i] else -w
                    waiting.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        place = {i: k for k, i in enumerate(rest)}
        links = [(place[i], place[j], w) for i, j, w in edges if i in place and j in place]
        side = _source_side([pull[i] for i in rest], links)
        for i, k in place.items():
            label[i] = side[k]
    return [bool(x) for x in label]


def _source_side(pull: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Max-flow by shortest augmenting paths in level graphs; True: on the source's side."""
    n = len(pull)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(u, v, there, back):
        out[u].append(len(to))
        to.append(v)
        room.append(there)
        out[v].append(len(to))
        to.append(u)
        room.append(back)

    for i, p in enumerate(pull):
        join(source, i, p, 0.0) if p > 0 else join(i, sink, -p, 0.0)
    for i, j, w in links:
        join(i, j, w, w)
    tiny = 1e-12
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        tried = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                path, u = [], source
                continue
            while tried[u] < len(out[u]):
                e = out[u][tried[u]]
                if room[e] > tiny and level[to[e]] == level[u] + 1:
                    break
                tried[u] += 1
            if tried[u] < len(out[u]):
                path.append(out[u][tried[u]])
                u = to[path[-1]]
            elif u == source:
                break
            else:
                tried[to[path[-1] ^ 1]] += 1
                u = to[path.pop() ^ 1]


def main_text(html: str) -> str:
    """The main text of one page."""
    blocks = blocks_of(html)
    labels = minimum_cut([(_softplus(-b.logit), _softplus(b.logit)) for b in blocks], _edges(blocks))
    return "\n\n".join(b.text for b, content in zip(blocks, labels) if content)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html)."""
    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "url": batch["url"], "text": [main_text(h) for h in batch["html"]]})

    rows = pages.select(F.col("page_id").cast("long").cast("string").alias("key"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    got = rows.mapInPandas(run, "key string, url string, text string")
    return got.select(F.col("key").cast("long").alias("page_id"), "url", "text",
                      F.length("text").cast("long").alias("n_chars"))
