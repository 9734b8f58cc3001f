"""Main text of web pages by minimum cuts.

A page becomes blocks (runs of text between block tags) under a tree of containers.
A logistic classifier with the weights below turns what is seen of a block (its tag,
length, links, punctuation, and the names and roles of the containers around it) into
the log odds that it is article text; these are the capacities from the source or to
the sink.  Neighbouring blocks are linked, more weakly across a change of container
(adjacency), and so are a block and its container, and a container and its parent
(proximity in the tree).  The minimum cut is the labelling that costs least: strong
evidence stands, and weak blocks follow their surroundings.  Blocks that no smoothing
can turn are labelled first, which is exact and leaves little for the flow.

A page is read whole in one pass, whatever its markup; its blocks and tree are the
only things held.

Defined results: a null or empty page gives an empty text, so does one without any
article text; markup that breaks off counts up to its end; repeated rows are rows of
their own; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

_MARKUP = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z)) | <!\[CDATA\[.*?(?:\]\]>|\Z) | <[!?][^>]*(?:>|\Z)
      | <(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>"']+|"[^"]*"|'[^']*'|["'])*+)(?:>|\Z)""",
    re.S | re.X,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_SPECIAL = re.compile(r"[^\W\d_]")

# Fixed values of HTML
RAW = {"script", "style", "noscript", "textarea", "title", "iframe", "noembed", "noframes", "xmp", "template", "svg", "math", "object", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
INLINE_VOID = {"img", "input", "wbr", "br", "embed", "area", "link", "meta", "base", "param", "source", "track"}
#: An opening tag of these closes an open one of the listed, within the nearest of SCOPES.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
SCOPES = {"ul", "ol", "dl", "table", "select", "menu", "html", "body"}

# The classifier: log odds, in hundredths
BIAS = -30
#: Containers, counted once a block each, strongest sign first seen from the block outwards.
TAGS = {"article": 260, "main": 200, "nav": -900, "footer": -700, "aside": -800, "form": -900, "menu": -900, "dialog": -900, "header": -120, "button": -900, "fieldset": -900, "address": -200, "head": -900}
ROLES = {"navigation": -900, "banner": -600, "contentinfo": -700, "complementary": -800, "search": -900, "menu": -900, "menubar": -900, "dialog": -900, "alertdialog": -900, "alert": -700, "toolbar": -900, "main": 200, "article": 260, "form": -900, "tablist": -900}
#: Words in class, id, itemprop and aria-label.
BAD_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adsbygoogle", "adbox", "adslot", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "copyright", "disclaimer",
    "disqus", "footer", "foot", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "overlay", "pager", "pagination", "paywall", "popup", "popover", "promo", "promoted", "promotion",
    "recommended", "recommendations", "related", "replies", "reply", "respond", "responses", "search", "share", "sharing", "shares", "sidebar", "sidenav", "signup", "skip", "social", "sponsor", "sponsored", "sponsors", "subscribe", "subscription",
    "tags", "toc", "toolbar", "topbar", "widget", "widgets", "alert", "hidden", "discussion", "feedback", "reviews", "dropdown", "trending", "popular", "outbrain", "taboola",
}
GOOD_NAMES = {"article", "articlebody", "body", "content", "entry", "main", "page", "post", "story", "text"}
MILD_NAMES = {"byline", "author", "dateline", "date", "meta", "metadata", "info", "credit", "caption", "header", "timestamp"}
BAD_NAME, GOOD_NAME, MILD_NAME = -800, 90, -110
#: A header of the page; one within an article may hold its title.
PAGE_HEADER = -700
OWN = {"p": 130, "h1": 90, "h2": 60, "h3": 50, "h4": 40, "h5": 20, "h6": 20, "blockquote": 90, "pre": 110, "li": -20, "td": -10, "th": -20, "figcaption": 10, "dd": 20, "dt": 10}
LENGTH = ((4, -60), (10, 10), (25, 90), (60, 170))  # fewer words than the first: -60; at least 4: 10, ...
SENTENCE, NO_LETTER, LINKED, HALF_LINKED = 50, -60, -320, -150
HIDDEN = -900

# Smoothness: neighbours in one container, across containers, and along the tree
NEIGHBOUR, ACROSS, IN_TREE = 70, 15, 45


class _Element:
    __slots__ = ("above", "name", "score", "strong", "number")

    def __init__(self, name: str, above: _Element | None, score: int, strong: int, number: int):
        self.name, self.above, self.score, self.strong, self.number = name, above, score, strong, number


class Page:
    """Blocks of a page: texts, their log odds, and the container of each."""

    def __init__(self, source: str):
        self.texts: list[str] = []
        self.odds: list[int] = []
        self.of: list[int] = []
        self.parent: list[int] = [-1]  # of containers, by number
        self.top = self.open = _Element("", None, 0, 0, 0)
        self.depth: dict[str, int] = {}
        self.parts: list[str] = []
        self.linked = self.links = 0
        self._read(source)
        self._end_block()

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            found = _MARKUP.search(source, at)
            if found is None:
                self._text(source[at:])
                return
            if found.start() > at:
                self._text(source[at : found.start()])
            at = found.end()
            if (name := found["name"]) is None:
                continue
            name = name.lower()
            if found["close"]:
                self._close(name)
            elif name in RAW and not found["rest"].endswith("/"):
                after = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = after.end() if after else end
            else:
                self._start(name, found["rest"])

    def _text(self, raw: str) -> None:
        # what starts like a tag but is none stays text
        text = html.unescape(raw) if "&" in raw else raw
        self.parts.append(text)
        if self.links:
            self.linked += len(text)

    def _start(self, name: str, rest: str) -> None:
        if name in INLINE:
            if name == "a":
                self.links += 1
            if (not rest or self._scores(name, rest)[1] >= 0) and name not in self.depth:
                return
            # an inline element that names itself an advert, a share button, ... is a block of its own, and so are those in it
        if name in INLINE_VOID:
            if name == "br":
                self.parts.append(" ")
            return
        self._end_block()
        if name in VOID:
            return
        if "p" in self.depth and name not in INLINE:
            self._close_within("p")
        for old in CLOSED_BY.get(name, ()):
            self._close_within(old)
        score, strong = self._scores(name, rest)
        self.parent.append(self.open.number)
        self.open = _Element(name, self.open, score, strong, len(self.parent) - 1)
        self.depth[name] = self.depth.get(name, 0) + 1

    def _scores(self, name: str, rest: str) -> tuple[int, int]:
        """Mild log odds of a container, and the strong ones (or 0)."""
        score, strong = 0, 0
        inside = "article" in self.depth or "main" in self.depth
        tag = PAGE_HEADER if name == "header" and not inside else TAGS.get(name, 0)
        if abs(tag) >= 500:
            strong = tag
        else:
            score += tag
        if not rest or rest == "/":
            return score, strong
        words: set[str] = set()
        for found in _ATTRIBUTE.finditer(rest):
            key = found[1].lower()
            value = found[2] or found[3] or found[4] or ""
            if key in ("class", "id", "itemprop", "aria-label", "data-component", "data-testid"):
                for piece in value.split():
                    words.add(piece.lower())
                    words.update(x.lower() for x in _TOKEN.findall(piece))
            elif key == "role":
                role = ROLES.get(value.strip().lower(), 0)
                if abs(role) >= 500:
                    strong = min(strong, role)
                else:
                    score += role
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                strong = HIDDEN
        if name not in ("html", "body", "article", "main"):
            if words & BAD_NAMES:
                strong = min(strong, BAD_NAME)
            elif "header" in words and not inside and not words & GOOD_NAMES:
                strong = min(strong, PAGE_HEADER)
        elif words & {"comment", "comments", "reply", "replies"} and name in ("article", "main"):
            strong = min(strong, BAD_NAME)
        if words & GOOD_NAMES and name not in ("html", "body"):
            score += GOOD_NAME
        if words & MILD_NAMES:
            score += MILD_NAME
        return score, strong

    def _close(self, name: str) -> None:
        if name == "a":
            self.links = max(0, self.links - 1)
        if name in INLINE and name not in self.depth:
            return
        self._end_block()
        if name in self.depth:
            self._close_to(name)

    def _close_within(self, name: str) -> None:
        """Close an open ``name``, if no element of SCOPES stands between."""
        at = self.open
        while at.above is not None and (at.name == name or at.name not in SCOPES):
            if at.name == name:
                self._close_to(name)
                return
            at = at.above

    def _close_to(self, name: str) -> None:
        while self.open.above is not None:
            gone = self.open
            self.open = gone.above
            left = self.depth[gone.name] - 1
            if left:
                self.depth[gone.name] = left
            else:
                del self.depth[gone.name]
            if gone.name == name:
                return

    def _end_block(self) -> None:
        if not self.parts:
            return
        text = " ".join("".join(self.parts).split())
        linked, self.parts, self.linked = self.linked, [], 0
        if not text:
            return
        odds = BIAS + OWN.get(self.open.name, 0)
        n = text.count(" ") + 1
        odds += next((gain for least, gain in reversed(LENGTH[1:]) if n >= least), LENGTH[0][1] if n < LENGTH[0][0] else 0)
        if text[-1] in ".!?…。！？:;\"'”»" and n >= 4:
            odds += SENTENCE
        if not _SPECIAL.search(text):
            odds += NO_LETTER
        share = linked / len(text)
        odds += LINKED if share > 0.8 else HALF_LINKED if share > 0.4 else 0
        strong, at, seen = 0, self.open, 0
        while at is not None:
            strong = min(strong, at.strong)
            seen += at.score
            at = at.above
        self.texts.append(text)
        self.odds.append(odds + max(-300, min(320, seen)) + strong)
        self.of.append(self.open.number)


def links_of(page: Page) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Odds of all nodes (blocks, then containers that hold blocks) and smoothness edges."""
    n = len(page.texts)
    node: dict[int, int] = {}
    odds = list(page.odds)
    edges = []
    for i, container in enumerate(page.of):
        below = i
        while container > 0:
            known = container in node
            if not known:
                node[container] = len(odds)
                odds.append(0)
            edges.append((below, node[container], IN_TREE))
            if known:
                break
            below, container = node[container], page.parent[container]
    edges += [(i, i + 1, NEIGHBOUR if page.of[i] == page.of[i + 1] or page.parent[page.of[i]] == page.parent[page.of[i + 1]] else ACROSS) for i in range(n - 1)]
    return odds, edges


def minimum_cut(odds: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """The labels of least cost: a node labelled against its odds costs them, an edge
    between different labels its weight. Of several such labellings, the one with the
    fewest true."""
    n = len(odds)
    odds = list(odds)
    around: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b:
            around[a][b] = around[a].get(b, 0) + w
            around[b][a] = around[b].get(a, 0) + w
    label: list[bool | None] = [None] * n
    # nodes that all their edges together cannot turn
    rest = [sum(x.values()) for x in around]
    todo = deque(range(n))
    while todo:
        x = todo.popleft()
        if label[x] is not None or not (odds[x] > rest[x] or odds[x] <= -rest[x]):
            continue
        label[x] = odds[x] > rest[x]
        for y, w in around[x].items():
            if label[y] is None:
                del around[y][x]
                rest[y] -= w
                odds[y] += w if label[x] else -w
                todo.append(y)
    left = [x for x in range(n) if label[x] is None]
    if left:
        kept = _cut({x: i for i, x in enumerate(left)}, left, odds, around)
        for x, value in zip(left, kept, strict=True):
            label[x] = value
    return [bool(x) for x in label]


def _cut(place: dict[int, int], left: list[int], odds: list[int], around: list[dict[int, int]]) -> list[bool]:
    """Max-flow by blocking flows in levels; true: on the source's side."""
    n = len(left)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[int] = []
    arcs: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(a: int, b: int, forth: int, back: int) -> None:
        arcs[a].append(len(to))
        to.append(b)
        room.append(forth)
        arcs[b].append(len(to))
        to.append(a)
        room.append(back)

    for x, i in place.items():
        if odds[x] > 0:
            arc(source, i, odds[x], 0)
        elif odds[x] < 0:
            arc(i, sink, -odds[x], 0)
        for y, w in around[x].items():
            if y in place and place[y] > i:
                arc(i, place[y], w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        line = deque([source])
        while line:
            x = line.popleft()
            for e in arcs[x]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    line.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        x = source
        while True:
            if x == sink:
                amount = min(room[e] for e in path)
                for k, e in enumerate(path):
                    room[e] -= amount
                    room[e ^ 1] += amount
                cut = next(k for k, e in enumerate(path) if not room[e])
                x = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while at[x] < len(arcs[x]) and not (room[arcs[x][at[x]]] and level[to[arcs[x][at[x]]]] == level[x] + 1):
                at[x] += 1
            if at[x] < len(arcs[x]):
                path.append(arcs[x][at[x]])
                x = to[path[-1]]
            elif path:
                x = to[path.pop() ^ 1]
                at[x] += 1
            else:
                break


def main_text(source: str | None) -> str:
    """The article of a page, one block a line."""
    if not source:
        return ""
    page = Page(source)
    labels = minimum_cut(*links_of(page))
    return "\n".join(text for text, kept in zip(page.texts, labels, strict=False) if kept)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages`` (page_id, url, html)."""
    rows = pages.select(pages["page_id"], pages["url"], pages["html"].cast("string").alias("text"))
    kinds = [common.arrow_type(rows.schema[c].dataType) for c in ("page_id", "url")]
    schema = pa.schema([("page_id", kinds[0]), ("url", kinds[1]), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, limit=1 << 22):
                texts = [main_text(x) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), common.longs([len(x) for x in texts])], schema=schema)

    id_type, url_type = (rows.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    return rows.mapInArrow(run, f"page_id {id_type}, url {url_type}, text string, n_chars long")
