"""Main text of web pages by minimum-cut labelling.

A page is a row of text blocks. A classifier gives every block a log-odds of being content, from where it stands
(element and class names above it), its length and its share of link text; that is the price of labelling it against
its odds. Blocks that follow each other and blocks of one parent are joined by smoothness edges, weaker the farther
apart they are in the document tree; an edge costs its capacity if its ends are labelled differently. The cheapest
labelling is a minimum cut between content and boilerplate. Blocks whose own price exceeds all their edges keep their
label in every minimum cut and are settled first; maximum flow settles the rest.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planshift.llm.shared import row_slices

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*)>", re.DOTALL
)
NAMES = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
SPACE = re.compile(r"\s+")
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Elements that begin and end a block of text; all others, known or not, stand in a line.
BLOCK = frozenset(
    "html head body div p ul ol dl li dt dd menu dir table caption thead tbody tfoot tr td th section article nav aside "
    "header footer main search form fieldset legend h1 h2 h3 h4 h5 h6 hgroup blockquote pre figure figcaption hr address "
    "details summary dialog center noframes xmp text foreignobject".split()
)
# Elements whose text is skipped, without a cut in the line that they stand in. A head needs no entry: what may stand in it
# is hidden or has no text, and anything else belongs to the body, as if the head had ended before it.
HIDDEN = frozenset("template desc metadata button select datalist optgroup option".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
# A formula once more in another language, which is not shown.
UNSHOWN = frozenset(("annotation", "annotation-xml"))
CLOSES_P = frozenset("p div ul ol dl li table section article nav aside header footer form h1 h2 h3 h4 h5 h6 blockquote pre main figure hr address fieldset".split())

# Log-odds of content by element above a block; the strongest sign of either kind counts once.
ELEMENT_ODDS = {
    "article": 4.0, "main": 3.0, "nav": -9.0, "footer": -9.0, "aside": -8.0, "form": -9.0, "header": -6.0, "menu": -9.0,
    "dialog": -8.0, "fieldset": -9.0,
    "blockquote": 0.5, "pre": 0.5, "figcaption": 0.3, "p": 1.0, "h1": 1.0, "h2": 0.7, "h3": 0.5, "h4": 0.4,
}
# Log-odds by words of class, id and role names. They count in full if the other words of the name say nothing (listed
# here or in PLAIN_WORDS); a name of other words too may mean anything, and length, links and neighbours decide.
NAME_ODDS = {
    **dict.fromkeys("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner".split(), -9.0),
    **dict.fromkeys("nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc toolbar".split(), -9.0),
    **dict.fromkeys("sidebar aside footer copyright legal masthead colophon".split(), -9.0),
    **dict.fromkeys("comment comments commentlist reply replies disqus respond discussion".split(), -9.0),
    **dict.fromkeys("cookie cookies consent notice notices alert warning gdpr popup modal overlay disclaimer".split(), -8.0),
    **dict.fromkeys("share sharing social related recommended newsletter subscribe subscription signup login search widget form".split(), -8.0),
    "header": -6.0,
    **dict.fromkeys("article post entry story content body text main maincontent".split(), 1.5),
}

PLAIN_WORDS = frozenset(
    "box wrapper wrap container inner outer area block section zone region list item items row col column unit slot left right "
    "top bottom first last head bar site page global primary secondary web desktop mobile mini sticky fixed inline module "
    "component view panel group holder links link button buttons icon icons title id js the my is has".split()
)
UNSURE = 0.3


def name_odds(name: str) -> list[float]:
    """Log-odds of the listed words of one class, id or role."""
    words = [w.lower() for w in NAME_WORDS.findall(name)]
    plain = all(w in NAME_ODDS or w in PLAIN_WORDS for w in words)
    return [NAME_ODDS[w] * (1.0 if plain or NAME_ODDS[w] > 0 else UNSURE) for w in words if w in NAME_ODDS]


@dataclass
class Block:
    text: str
    links: int
    parent: int
    odds: float = 0.0


@dataclass
class Tree:
    """Open elements while a page is read: for each its parent, depth, and the strongest signs above it."""

    tag: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    good: list[float] = field(default_factory=lambda: [0.0])
    bad: list[float] = field(default_factory=lambda: [0.0])

    def add(self, tag: str, attributes: str, parent: int) -> int:
        odds = [ELEMENT_ODDS.get(tag, 0.0)]
        if attributes and "=" in attributes:
            for m in NAMES.finditer(attributes):
                for name in (m[1] or m[2] or m[3] or "").split():
                    odds += name_odds(name)
        inside = self.good[parent] >= 3.0
        if inside:  # a heading area within an article belongs to it
            odds = [0.0 if o == -6.0 else o for o in odds]
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.good.append(max(self.good[parent], *odds, 0.0))
        self.bad.append(min(self.bad[parent], *odds, 0.0))
        return len(self.tag) - 1

    def distance(self, a: int, b: int) -> int:
        steps = 0
        while a != b:
            if self.depth[a] < self.depth[b]:
                a, b = b, a
            a = self.parent[a]
            steps += 1
        return steps


def end_tag(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?![^\s/>])[^>]*>", re.IGNORECASE)


def read_blocks(page: str) -> tuple[list[Block], Tree]:
    """Text blocks in page order; character references are decoded, white space is one space."""
    tree, at, blocks = Tree(), 0, []
    words: list[str] = []
    links = anchor = pos = 0
    silent = 0  # the element whose text is skipped, 0: none

    def flush() -> None:
        nonlocal words, links
        if words:
            text = SPACE.sub(" ", html.unescape("".join(words))).strip()
            if text:
                blocks.append(Block(text, links, at))
            words, links = [], 0

    def say(text: str) -> None:
        nonlocal links
        if text and not silent:
            words.append(text)
            if anchor:
                links += len(text)

    while m := TOKEN.search(page, pos):
        say(page[pos:m.start()])
        pos = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in UNSHOWN:
            end = None if m[1] or m[3].endswith("/") else end_tag(tag).search(page, pos)
            pos = end.end() if end else pos
            continue
        if tag in RAW and tag != "xmp":
            end = None if m[1] else end_tag(tag).search(page, pos)
            pos = pos if m[1] else end.end() if end else len(page)
            continue
        if tag not in BLOCK and tag not in HIDDEN:
            if tag == "a":
                anchor = 0 if m[1] else 1
            elif tag == "br":
                say(" ")
            continue
        if tag in BLOCK and not silent:
            flush()
        if m[1]:
            node = at
            while node and tree.tag[node] != tag:
                node = tree.parent[node]
            if node:
                if silent and tree.depth[silent] >= tree.depth[node]:
                    at, silent = tree.parent[silent], 0
                    if tag in BLOCK:  # the end of an element around the hidden one
                        flush()
                at = tree.parent[node]
                if tag in BLOCK:
                    anchor = 0
            continue
        if tag == "hr":
            continue
        if tag in CLOSES_P and tree.tag[at] == "p" or tag == tree.tag[at] and tag in ("li", "option", "tr", "td", "th", "dt", "dd"):
            at = tree.parent[at]
            if silent and tree.depth[silent] > tree.depth[at]:
                silent = 0
        if tag == "body":
            node = at
            while node and tree.tag[node] != "head":
                node = tree.parent[node]
            if node:
                at, silent = tree.parent[node], 0
        if m[3].endswith("/") and tag != "xmp":
            continue
        if tag == "xmp":  # shown letter by letter
            end = end_tag(tag).search(page, pos)
            at = tree.add(tag, m[3], at)
            say(html.escape(page[pos:end.start() if end else len(page)]))
            flush()
            at = tree.parent[at]
            pos = end.end() if end else len(page)
            continue
        at = tree.add(tag, "" if tag == "head" else m[3], at)
        if tag in BLOCK:
            anchor = 0
        elif not silent:
            silent = at
    say(page[pos:])
    flush()
    return blocks, tree


def content_odds(block: Block, tree: Tree, prior: float) -> float:
    """The classifier: log-odds that a block is content."""
    length = len(block.text)
    odds = prior + tree.good[block.parent] + tree.bad[block.parent]
    odds += min(math.log1p(length / 40), 2.5)
    odds -= 4.0 * min(block.links / length, 1.0)
    return odds


def minimum_cut(odds: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels (True: content) of the cheapest labelling; ties go to boilerplate."""
    n = len(odds)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for (a, b), c in edges.items():
        near[a][b] = near[b][a] = near[a].get(b, 0) + round(1000 * c)
    own = [round(1000 * o) for o in odds]
    label: list[bool | None] = [None] * n
    # a block whose price exceeds its edges keeps its label; its edges become prices of its neighbours
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(own[i]) > sum(near[i].values()):
            label[i] = own[i] > 0
            for j, c in near[i].items():
                own[j] += c if label[i] else -c
                del near[j][i]
                if label[j] is None:
                    todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if not rest:
        return label
    flow = {i: dict(near[i]) for i in rest}
    source = {i: max(own[i], 0) for i in rest}
    sink = {i: max(-own[i], 0) for i in rest}
    while True:  # shortest augmenting paths
        before: dict[int, int] = {i: -1 for i in rest if source[i] > 0}
        line, end = deque(before), None
        while line:
            i = line.popleft()
            if sink[i] > 0:
                end = i
                break
            for j, c in flow[i].items():
                if c > 0 and j not in before:
                    before[j] = i
                    line.append(j)
        if end is None:
            break
        path = [end]
        while before[path[-1]] >= 0:
            path.append(before[path[-1]])
        push = min([source[path[-1]], sink[end], *(flow[a][b] for b, a in zip(path, path[1:], strict=False))])
        source[path[-1]] -= push
        sink[end] -= push
        for b, a in zip(path, path[1:], strict=False):
            flow[a][b] -= push
            flow[b][a] += push
    for i in rest:
        label[i] = i in before
    return label


def main_text(page: str | None) -> str:
    """The content blocks of a page, in page order, joined by line feeds; empty if there are none."""
    blocks, tree = read_blocks(page or "")
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, block in enumerate(blocks):
        if i:
            edges[i - 1, i] = 1.2 * 0.6 ** tree.distance(blocks[i - 1].parent, block.parent)
        container = tree.parent[block.parent]
        if container in last:
            pair = (last[container], i)
            edges[pair] = edges.get(pair, 0.0) + 0.8
        last[container] = i
    # where an element says that it holds the article, blocks are less likely to be content by themselves
    prior = -0.5 if max(tree.good) >= 3.0 else 0.2
    labels = minimum_cut([content_odds(b, tree, prior) for b in blocks], edges)
    return "\n".join(b.text for b, keep in zip(blocks, labels, strict=True) if keep)


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``key``, ``url``, ``text`` and ``n_chars`` (code points) of every page.

    Null and empty pages give an empty text, as do pages without content. Repeated rows give equal rows; an empty table
    gives none. Other columns are not read. Each page is worked off by itself, so nothing is shuffled.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_slices(batch, "__page"):
                texts = [main_text(p) for p in rows.column(2).to_pylist()]
                yield pa.record_batch(
                    [rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["__key", "__url", "__text", "__n"],
                )

    rows = pages.select(F.col(key).alias("__key"), F.col(url).cast("string").alias("__url"), F.col(page).cast("string").alias("__page"))
    kind = rows.schema["__key"].dataType.simpleString()
    made = rows.mapInArrow(work, f"__key {kind}, __url string, __text string, __n long")
    return made.select(
        F.col("__key").alias(key), F.col("__url").alias(url), F.col("__text").alias("text"), F.col("__n").alias("n_chars")
    )
