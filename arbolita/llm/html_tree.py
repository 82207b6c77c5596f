"""Main-text extraction from HTML by tree scoring.

Every paragraph (``p``, ``pre``, ``td``, ``blockquote``, and ``div``s that hold text of their own) of at least 25 characters
scores 1 point, 1 for each comma and 1 for each 100 characters up to 3. Its parent gets the score, its grandparent half, the
next two ancestors a third and a quarter of the points. A container's score is its points times (1 - link density), link density
being the share of its characters inside ``a``. The container of the highest score is kept, and of its siblings those that
score at least max(10, a fifth of the best), or are paragraphs of more than 80 characters and link density under 1/4, or
shorter ones without links that end a sentence. Scripts, styles, comments and the like have no text. ``nav``, ``footer``, ``aside``, ``form``, ``header`` and elements
whose class or id names an advertisement, menu, sidebar or the like are apart: what is in them neither scores nor is kept as
a sibling.

The text is that of the kept nodes in document order, one line per block element, white space collapsed. The parser accepts any
input: unclosed ``p``, ``li`` and table cells end where HTML ends them, other end tags close up to the nearest element
of that name, stray ones are ignored.

Defined results: a null page gives a null text; a page without scoring paragraphs gives the text of the body; an empty one
an empty text; ties go to the container that begins first; equal rows give equal results; an empty table gives no rows; only
the two named columns are read; ids keep their type. Time is linear in the page, however deep its elements are nested.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbolita.llm.batches import id_type, slices

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:\-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset("script style noscript template svg math iframe object select textarea title head".split())
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noscript")}
_BLOCK = frozenset(
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split()
)
_ENDS_P = _BLOCK - {"br", "td", "th", "tr", "body"}
_CLOSES = {"li": ("li", ("ul", "ol")), "td": ("td", ("tr", "table")), "th": ("th", ("tr", "table")), "tr": ("tr", ("table",)), "dt": ("dd", ("dl",)), "dd": ("dt", ("dl",)), "option": ("option", ("select",))}
#: Elements at which the search for the one that an end is implied of goes on or stops.
_STOPS = frozenset(x for tag, (same, within) in _CLOSES.items() for x in (tag, same, *within))
_PARAGRAPH = frozenset(("p", "pre", "td", "blockquote", "div"))
_APART = frozenset(("nav", "footer", "aside", "form", "header"))
_UNLIKELY = re.compile(
    r"""(?i)\b(?:class|id)\s*=\s*["']?[^"'>]*\b(?:ads?|advert\w*|banner|breadcrumbs?|comments?|disqus|foot(?:er)?|header|menu|pager|pagination|popup|promo|related|rss|share|sidebar|social|sponsor\w*|widget)\b"""
)
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "order", "apart", "points", "chars", "linked", "own", "commas", "block", "stop")

    def __init__(self, tag: str, parent: Node | None, order: int):
        self.tag, self.parent, self.order = tag, parent, order
        self.children: list[Node | str] = []
        self.apart = False
        self.points = 0.0
        self.chars = self.linked = self.own = self.commas = 0
        #: the nearest element, from this one up, of each kind
        self.block: Node = self if tag in _BLOCK or parent is None else parent.block
        self.stop: Node | None = self if tag in _STOPS else parent.stop if parent is not None else None


def parse(page: str) -> tuple[Node, list[Node]]:
    """The root, and all elements in document order."""
    root = at = Node("html", None, 0)
    nodes, done, end = [root], 0, len(page)
    opened: dict[str, int] = defaultdict(int)  # how many elements of a tag are open

    def leave(node: Node) -> Node:
        """Close everything down to ``node``; where the walk goes on."""
        at_ = at
        while True:
            opened[at_.tag] -= 1
            if at_ is node:
                return node.parent
            at_ = at_.parent

    while done < end:
        m = _TOKEN.search(page, done)
        if m is None:
            at.children.append(page[done:])
            break
        if m.start() > done:
            at.children.append(page[done : m.start()])
        done = m.end()
        if not m.group(2):
            continue
        tag = m.group(2).lower()
        if m.group(1):
            if opened[tag] > 0:
                node = at
                while node.tag != tag:
                    node = node.parent
                at = leave(node)
            continue
        if tag == "html":
            continue
        if tag in _ENDS_P:  # a block ends a paragraph that is open
            if at.block.tag == "p":
                at = leave(at.block)
        if tag in _CLOSES:
            same, within = _CLOSES[tag]
            if opened[tag] > 0 or opened[same] > 0:
                node = at.stop
                while node is not None and node.tag not in (tag, same) and node.tag not in within:
                    node = node.parent.stop
                if node is not None and node.tag in (tag, same):
                    at = leave(node)
        node = Node(tag, at, len(nodes))
        node.apart = at.apart or tag in _APART or tag != "body" and m.group(3) != "" and _UNLIKELY.search(m.group(3)) is not None
        at.children.append(node)
        nodes.append(node)
        if tag in _RAW and not m.group(3).endswith("/"):
            close = _RAW[tag].search(page, done)
            done = close.end() if close else end
        elif tag not in _VOID and not m.group(3).endswith("/"):
            at = node
            opened[tag] += 1
    return root, nodes


def _measure(nodes: list[Node]) -> None:
    """Characters, linked and own characters and commas of each element, from the leaves up; references in its text are resolved."""
    for node in reversed(nodes):
        if node.tag in _HIDDEN:
            node.children = []
            continue
        node.own = 0
        for k, c in enumerate(node.children):
            if isinstance(c, str):
                t = html.unescape(c) if "&" in c else c
                node.children[k] = t
                node.commas += t.count(",") + t.count("，")
                bare = len(t) if "  " not in t and "\n" not in t else len(_SPACE.sub(" ", t))
                if bare and not t.isspace():
                    node.own += bare
                    node.chars += bare
            else:
                node.chars += c.chars
                node.linked += c.linked
                node.commas += c.commas
        if node.tag == "a":
            node.linked = node.chars


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _render(keep: list[Node]) -> str:
    parts: list[str] = []

    stack: list[Node | str] = list(reversed(keep))
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            parts.append(_SPACE.sub(" ", c))
        else:
            block = c.tag in _BLOCK
            if block:
                parts.append("\n")
                stack.append("\0")
            stack.extend(reversed(c.children))
    lines = (" ".join(x.split()) for x in "".join(parts).replace("\0", "\n").split("\n"))
    return "\n".join(x for x in lines if x)


def extract(page: str | None) -> tuple[str | None, float, int]:
    """(text, score of the best container, nodes kept)."""
    if page is None:
        return None, 0.0, 0
    root, nodes = parse(page.replace("\0", ""))
    _measure(nodes)
    scored = []
    for node in nodes:
        if node.tag not in _PARAGRAPH or node.apart or node.chars < 25 or node.tag == "div" and node.own < 25:
            continue
        points = 1 + node.commas + min(node.chars // 100, 3)
        up, share = node.parent, (1.0, 1 / 2, 1 / 3, 1 / 4)
        for s in share:
            if up is None:
                break
            if not up.points:
                scored.append(up)
            up.points += points * s
            up = up.parent
    if not scored:
        body = next((x for x in nodes if x.tag == "body"), root)
        return _render([body]), 0.0, 0
    score = {id(x): x.points * (1 - _density(x)) for x in scored}
    best = max(scored, key=lambda x: (score[id(x)], -x.order))
    top = score[id(best)]
    keep: list[Node] = []
    for c in best.parent.children if best.parent is not None else [best]:
        if isinstance(c, str):
            continue
        if c is best:
            keep.append(c)
        elif c.apart:
            continue
        elif score.get(id(c), 0.0) >= max(10.0, top / 5):
            keep.append(c)
        elif c.tag == "p":
            d = _density(c)
            if c.chars > 80 and d < 0.25 or 0 < c.chars <= 80 and not d and re.search(r"[.!?](?:\s|$)", _render([c])):
                keep.append(c)
    return _render(keep), top, len(keep)


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id, text, score, nodes_kept`` of every page."""

    def run(batches):
        for batch in slices(batches):
            got = [extract(p) for p in batch.column(1).to_pylist()]
            text, score, kept = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(text, pa.string()), pa.array(score, pa.float64()), pa.array(kept, pa.int32())],
                names=["page_id", "text", "score", "nodes_kept"],
            )

    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    return narrow.mapInArrow(run, f"page_id {id_type(pages, id_col)}, text string, score double, nodes_kept int")
