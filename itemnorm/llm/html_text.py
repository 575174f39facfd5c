"""Main text of web pages by a minimum cut between content and boilerplate.

A page is cut into blocks: the text between block-level tags, with its path in the document tree. Each block gets a
cost for either label from a linear rule over its path, its names (class, id, role) and its text. The costs are
capacities to two terminals; neighbours in page order and neighbouring children of one parent are joined by edges
that are the stronger the closer they stand in the tree. The minimum cut labels all blocks at once, so a short
paragraph inside an article follows the paragraphs around it, and a long notice between menus follows the menus.

Null and empty pages, and pages without content, have an empty text. Unclosed tags, comments and scripts end with the
page. Every page is worked on whole.
"""

from __future__ import annotations

import html
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_rows

# ---------------------------------------------------------------- blocks

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<(?P<raw>script|style|noscript|template|iframe|svg|math|textarea|select|title|object|audio|video|canvas)"
    r"(?=[\s/>])[^>]*>(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[a-zA-Z!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[a-z]+")

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp"
    " small span strike strong sub sup time tt u var wbr input progress".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag closes these if open, up to the nearest of the second set.
CLOSES = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}),
          "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}

# ---------------------------------------------------------------- the rule

#: Weights of elements on a block's path: above 0 speaks for content.
ELEMENTS = {"article": 6, "main": 3, "nav": -14, "footer": -14, "aside": -14, "form": -14, "menu": -14, "dialog": -14,
            "button": -14, "header": -14, "address": -3, "figcaption": 0, "p": 2, "blockquote": 2, "pre": 2, "h1": 2,
            "h2": 1, "h3": 1, "td": 0, "li": -1}
#: Weights of words in class, id and role.
GOOD = {w: 3 for w in "article content post entry story main body text prose".split()}
BAD = {w: -14 for w in (
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu"
    " sidebar aside footer header masthead breadcrumb breadcrumbs comment comments disqus respond reply replies cookie"
    " cookies consent gdpr notice notices alert popup modal overlay subscribe subscription newsletter share sharing social"
    " related recommended widget login signin signup search toolbar pagination pager copyright legal disclaimer skip"
    " complementary contentinfo form"
).split()}
SCALE = 100
#: Elements whose names never speak against what they hold.
FRAME = frozenset(("html", "body", "main"))
#: Elements that are no frame, whatever they hold.
ASIDE = frozenset(("nav", "aside", "footer", "dialog", "menu"))


class Node:
    """An open element. What its tag and its names say against it does not count where it is a frame (``holds``): a page may
    name its frame after a part that it has or lacks."""

    __slots__ = ("tag", "parent", "depth", "good", "bad", "holds", "in_article", "known")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.in_article = tag == "article" or (parent.in_article if parent else False)
        own = ELEMENTS.get(tag, 0)
        if tag == "header" and parent and parent.in_article:
            own = -3  # an article's own header holds its title
        self.holds, self.known = tag in FRAME, None
        names = [w for m in NAMES.finditer(attrs) for w in PARTS.findall((m[1] or m[2] or m[3] or "").lower())]
        bad = min((BAD[w] for w in names if w in BAD), default=0)
        good = max((GOOD[w] for w in names if w in GOOD), default=0)
        self.good, self.bad = max(own, 0) + good, min(own, 0) + bad
        if bad:
            self.good -= good

    @property
    def weight(self) -> float:
        """Known when the page has been read whole."""
        if self.known is None:
            todo, at = [], self
            while at is not None and at.known is None:
                todo.append(at)
                at = at.parent
            for node in reversed(todo):
                above = node.parent.known if node.parent else 0
                own = node.good + (0 if node.holds else node.bad)
                node.known = max(-40, min(above + own, 8))
        return self.known


class Block:
    __slots__ = ("node", "pieces", "linked", "text")

    def __init__(self, node: Node):
        self.node, self.pieces, self.linked = node, [], 0

    def score(self) -> float:
        """Above 0 speaks for content."""
        size = max(1, len(self.text))
        words = self.text.count(" ") + 1
        links = min(1.0, self.linked / size)
        return self.node.weight - 6 * links + min(3.0, words / 10) + (0.5 if self.text[-1] in ".!?:;\"”»" else -0.5) - 1


def mark_frames(tops: list[Node]) -> None:
    """Frames are the elements that hold all of the page's ``tops``: articles and main elements that no name speaks against.
    Each element is passed once, on the way up from the first top below it."""
    if not tops:
        return
    passed, lowest = set(), tops[0].parent
    for top in tops:
        at = top.parent
        while at and at not in passed:
            passed.add(at)
            at = at.parent
        if top is not tops[0] and at and at.depth < lowest.depth:
            lowest = at
    while lowest:
        lowest.holds = lowest.tag not in ASIDE
        lowest = lowest.parent


def blocks_of(page: str) -> list[Block]:
    root = Node("", "", None)
    tops: list[Node] = []
    stack, links, last, out = [root], 0, 0, []
    now = Block(root)

    def flush(node: Node):
        nonlocal now
        text = " ".join("".join(now.pieces).split())
        if text:
            now.text = text
            out.append(now)
        now = Block(node)

    def close(tags: frozenset | set | tuple, stop: set) -> bool:
        """Close the innermost of ``tags`` that is open inside the nearest of ``stop``."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return True
            if stack[i].tag in stop:
                return False
        return False

    def put(raw: str):
        if raw:
            if not now.pieces:
                now.node = stack[-1]
            text = html.unescape(raw)
            now.pieces.append(text)
            if links:
                now.linked += len(text.strip())

    for m in TOKEN.finditer(page):
        put(page[last : m.start()])
        last = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            now.pieces.append(" ")
        elif tag in INLINE:
            if tag == "a":
                links = max(0, links - 1) if m["close"] else 1
        elif m["close"]:
            flush(stack[-1])
            close((tag,), set())
            links = 0
            now.node = stack[-1]
        else:
            flush(stack[-1])
            close(("p",), {"td", "th", "li", "div", "section", "article", "blockquote", "body"})
            if tag in CLOSES:
                inner, stop = CLOSES[tag]
                while close(tuple(inner.split()), stop):
                    pass
            if tag not in VOID:
                stack.append(Node(tag, m["attrs"] or "", stack[-1]))
                if tag in ("article", "main") and not stack[-1].bad and not stack[-2].in_article:
                    tops.append(stack[-1])
            links = 0
            now.node = stack[-1]
    put(page[last:])
    flush(root)
    mark_frames(tops)
    return out


# ---------------------------------------------------------------- the cut


def distance(a: Node, b: Node) -> int:
    """Steps between two nodes of the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def neighbours(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """(i, j, capacity): next in page order, and next among the blocks of one grandparent."""
    edges = [
        (i, i + 1, SCALE * 4 // (1 + distance(blocks[i].node, blocks[i + 1].node))) for i in range(len(blocks) - 1)
    ]
    seen: dict[int, int] = {}
    for i, b in enumerate(blocks):
        above = id(b.node.parent or b.node)
        if above in seen and seen[above] < i - 1:
            edges.append((seen[above], i, SCALE * 4 // (1 + distance(blocks[seen[above]].node, b.node))))
        seen[above] = i
    return edges


def source_side(n: int, strength: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Labels of the minimum cut: node i is joined to the source by ``strength[i]`` if positive, else to the sink.
    Dinic's algorithm; every edge carries both ways. Of several minimum cuts the one with the smallest source side."""
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]
    s, t = n, n + 1

    def join(a: int, b: int, there: int, back: int):
        out[a].append(len(to))
        to.append(b)
        room.append(there)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, c in enumerate(strength):
        if c > 0:
            join(s, i, c, 0)
        elif c < 0:
            join(i, t, -c, 0)
    for a, b, c in edges:
        if c > 0:
            join(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        todo = deque([s])
        while todo:
            a = todo.popleft()
            for e in out[a]:
                if room[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    todo.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        spot = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(room[e] for e in path)
                for k, e in enumerate(path):
                    room[e] -= flow
                    room[e ^ 1] += flow
                first = next(k for k, e in enumerate(path) if room[e] == 0)
                a = to[path[first] ^ 1]
                del path[first:]
                continue
            while spot[a] < len(out[a]):
                e = out[a][spot[a]]
                if room[e] > 0 and level[to[e]] == level[a] + 1:
                    break
                spot[a] += 1
            else:
                if a == s:
                    break
                level[a] = -1
                a = to[path.pop() ^ 1]
                continue
            path.append(e)
            a = to[e]


def extract(page: str | None) -> str:
    """The main text of a page: content blocks in page order, joined by an empty line."""
    blocks = blocks_of(page or "")
    strength = [round(SCALE * b.score()) for b in blocks]
    if not any(c > 0 for c in strength):
        return ""
    if all(c > 0 for c in strength):
        keep = [True] * len(blocks)
    else:
        keep = source_side(len(blocks), strength, neighbours(blocks))
    return "\n\n".join(b.text for b, k in zip(blocks, keep) if k)


def main_text(pages: DataFrame, page: str = "html", text: str = "text") -> DataFrame:
    """``pages`` without ``page`` and plus its main ``text``."""
    keeps = [c for c in pages.columns if c not in (page, text)]

    def make():
        return lambda htmls: [pa.array([extract(h) for h in htmls], pa.string())]

    return map_rows(pages, [page], keeps, T.StructType([T.StructField(text, T.StringType())]), make)
