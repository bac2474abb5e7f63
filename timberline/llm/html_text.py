"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks (runs of text that no block-level tag divides). A linear classifier over each block's
ancestors, their class, id and role words, its links and its text gives the cost of calling it content or boilerplate;
these are the capacities to the two terminals. Its weights are stated below: pages carry no labels to fit them on. Blocks next to each other on the page, and blocks next to each other
under one parent, are joined by edges whose capacity falls with their distance in the DOM. The maximum flow separates
content from boilerplate at the least total cost.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: What ends a tag or may begin or end a quoted value in it.
MARK = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

#: Fixed values of HTML: elements without content, with raw text, of other vocabularies (where
#: a tag may close itself), and those that break a line of text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe xmp noembed noframes".split())
FOREIGN = ("svg", "math")
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html iframe label legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
#: A start tag of the key closes an open element of the values, up to the nearest of SCOPE.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
CLOSES |= {t: {"p"} for t in BLOCKS - {"p", "li", "dt", "dd", "tr", "td", "th", "option", "tbody", "button", "label", "body", "head", "html"}}
SCOPE = set("article aside body button blockquote div dl fieldset figure footer form header html li main nav ol section table td th ul".split())

#: Weights of the classifier. A tag or a class word is positive for content; a weak sign of boilerplate is set off against
#: them, a strong one holds for all below it, whatever stands around or inside it.
PLUS = {"article": 4.0, "main": 3.0}
PLUS_WORDS = set("article content post entry story main text".split())
PLUS_WORD, MOST = 2.0, 6.0
STRONG_TAGS = set("nav footer aside form button select menu dialog fieldset".split())
WEAK_TAGS = {"header": -1.0, "label": -3.0}
STRONG_WORDS = set(
    "nav navbar navigation menu menubar sidebar ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice notices notification alert "
    "popup modal overlay footer masthead breadcrumb breadcrumbs newsletter login signin search searchbox toolbar pagination pager copyright paywall outbrain taboola".split()
)
COMMENT_WORDS = set("comment comments commentlist disqus".split())
WEAK_WORDS = set("side aside foot header share sharing social related recommend recommended recommendations reply replies respond responses discussion subscribe subscription signup widget legal disclaimer tags skip teaser".split())
#: In a class such as has-sidebar, comments-open or category-ads these say that the rest names a state or a subject, not
#: what the element is.
FLAGS = set("has no not with without is show hide open closed enabled disabled on off count layout theme template category cat tag type format status supports".split())
STRONG, WEAK, HEADER, HIDDEN = -7.0, -3.0, -4.0, -20.0
LINK, LONG, HEADING, SENTENCE, BIAS = -4.0, 1.5, 1.0, 0.5, 0.2
#: Share of a page's prose that an article must hold for its ancestors' class words to be taken for a layout.
MAJOR = 0.5
#: Capacity between neighbours at DOM distance 1, and its share left where their ancestors' weights differ.
SMOOTH, ACROSS = 2.0, 0.05


@dataclass
class Block:
    """text; node: index of the parent element; links: characters inside links."""

    text: str
    node: int
    links: int


@dataclass(slots=True)
class Node:
    """An element: its parent's index, its tag, its own signs (positive, weak, strong by tag, strong by class words)."""

    parent: int
    tag: str
    plus: float = 0.0
    weak: float = 0.0
    strong: float = 0.0
    worded: float = 0.0


def tag_end(page: str, at: int, quotes: bool) -> int:
    """Where the tag whose attributes begin at `at` ends (its >); -1 if nowhere. A quote after = hides > up to its pair."""
    while True:
        m = MARK.search(page, at)
        if m is None:
            return -1
        at = m.end()
        if m[0] == ">":
            return m.start()
        if quotes and page[m.start() - 1] == "=":
            close = page.find(m[0], at)
            if close < 0:
                return -1
            at = close + 1


def parse(page: str) -> tuple[list[Block], list[Node]]:
    """Text blocks in page order, and the elements, parents before their children. Takes time in proportion to the
    page, whatever is left open in it."""
    nodes = [Node(-1, "")]
    stack = [0]
    opened: dict[str, list[int]] = {}  # places in the stack of the open elements, by tag
    scopes = [0]  # and of those of SCOPE
    blocks: list[Block] = []
    text: list[str] = []
    links = in_link = at = 0
    last_close = page.rfind(">")
    quotes = True
    lower = ""

    def pop_to(k: int) -> None:
        for i in stack[k:]:
            opened[nodes[i].tag].pop()
        del stack[k:]
        while scopes[-1] >= k:
            scopes.pop()

    def flush() -> None:
        nonlocal links
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            if joined:
                blocks.append(Block(joined, stack[-1], links))
            text.clear()
        links = 0

    def say(part: str) -> None:
        nonlocal links
        if part:
            text.append(part)
        if in_link:
            links += len(part.strip())

    while at < len(page):
        start = page.find("<", at)
        if page.startswith("<!--", start) and start >= 0:
            say(page[at:start])
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        if start < 0:
            say(page[at:])
            break
        say(page[at:start])
        if start >= last_close:  # no tag can end any more
            say("<")
            at = start + 1
            continue
        if page[start + 1] in "!?":
            at = page.find(">", start) + 1
            continue
        closing = page[start + 1] == "/"
        name = NAME.match(page, start + 1 + closing)
        if name is None:
            say("<")
            at = start + 1
            continue
        end = tag_end(page, name.end(), quotes)
        if end < 0:  # a quote is never closed: from here on quotes hide nothing
            quotes = False
            end = page.find(">", name.end())
        at = end + 1
        tag = name[0].lower()
        if closing:
            if tag in BLOCKS:
                flush()
            if tag == "a":
                in_link = 0
            if opened.get(tag) and (tag in BLOCKS or opened[tag][-1] >= scopes[-1]):
                pop_to(opened[tag][-1])
            continue
        attributes = page[name.end() : end]
        if tag in RAW:
            if tag in BLOCKS:
                flush()
            lower = lower or page.translate(ASCII_LOWER)
            end = lower.find(f"</{tag}", at)
            close = page.find(">", end) if end >= 0 else -1
            at = close + 1 if close >= 0 else len(page)
            continue
        if tag in BLOCKS:
            flush()
        if tag == "br":
            text.append(" ")
        if tag in VOID or attributes.endswith("/") and (tag in FOREIGN or any(opened.get(f) for f in FOREIGN)):
            continue
        closes = max((opened[c][-1] for c in CLOSES.get(tag, ()) if opened.get(c)), default=-1)
        if closes >= scopes[-1] > -1 and closes > 0:
            pop_to(closes)
        if tag == "a":
            in_link = 1
        nodes.append(signs(stack[-1], tag, attributes))
        stack.append(len(nodes) - 1)
        opened.setdefault(tag, []).append(len(stack) - 1)
        if tag in SCOPE:
            scopes.append(len(stack) - 1)
    flush()
    return blocks, nodes


def signs(parent: int, tag: str, attributes: str) -> Node:
    """An element with what its tag and attributes say about the text in it."""
    node = Node(parent, tag, PLUS.get(tag, 0.0), WEAK_TAGS.get(tag, 0.0), STRONG if tag in STRONG_TAGS else HIDDEN if tag == "head" else 0.0)
    if tag in ("body", "html") or "=" not in attributes and "hidden" not in attributes:
        return node
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role", "aria-label", "data-role"):
            for mark in value.split():
                words = {w.lower() for w in WORD.findall(mark)}
                if words & FLAGS:
                    continue
                if words & COMMENT_WORDS:
                    node.strong = min(node.strong, STRONG)
                elif words & STRONG_WORDS:
                    node.worded = STRONG
                elif words & WEAK_WORDS:
                    node.weak = min(node.weak, WEAK)
                elif words & PLUS_WORDS:
                    node.plus = max(node.plus, PLUS_WORD)
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            node.strong = HIDDEN
    return node


def contexts(blocks: list[Block], nodes: list[Node]) -> list[float]:
    """What the elements on the way from the root say about the text in each element.

    The article or main element with most of the page's prose (see MAJOR), unless a strong tag is around it, makes its
    ancestors' and its own strong words void: they describe a layout, like `sidebar-right` around all of a page.
    """
    prose = [0] * len(nodes)
    for b in blocks:
        prose[b.node] += max(0, len(b.text) - b.links)
    whole = sum(prose)
    for i in range(len(nodes) - 1, 0, -1):
        prose[nodes[i].parent] += prose[i]
    tagged = [0.0] * len(nodes)
    for i, n in enumerate(nodes[1:], 1):
        tagged[i] = min(tagged[n.parent], n.strong)
    own = max((i for i, n in enumerate(nodes) if n.tag in PLUS and tagged[i] == 0), key=lambda i: (prose[i], -i), default=0)
    void = set()
    while own > 0 and (void or prose[own] >= MAJOR * whole > 0):
        void.add(own)
        own = nodes[own].parent
    plus, weak, strong = [0.0] * len(nodes), [0.0] * len(nodes), [0.0] * len(nodes)
    for i, n in enumerate(nodes[1:], 1):
        up = n.parent
        plus[i] = min(MOST, plus[up] + n.plus)
        weak[i] = weak[up] + (HEADER if n.tag == "header" and plus[up] == 0 else n.weak)
        strong[i] = min(strong[up], n.strong, 0.0 if i in void else n.worded)
    return [s if s else p + w for p, w, s in zip(plus, weak, strong, strict=True)]


def score(block: Block, tag: str, context: float) -> float:
    n = len(block.text)
    s = context + BIAS + LONG * min(1.0, n / 120)
    s += LINK * min(1.0, block.links / n)
    s += HEADING * (tag in ("h1", "h2", "h3")) + SENTENCE * (block.text[-1] in ".!?…\"”")
    return s


def distance(a: int, b: int, nodes: list[Node]) -> int:
    """Steps in the DOM between two elements, siblings and the same element: 1."""
    steps = 0
    while a != b:
        if a > b:  # parents come before their children
            a = nodes[a].parent
        else:
            b = nodes[b].parent
        steps += 1
    return max(1, steps - 1)


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source (content) in a minimum cut. costs: positive to the source, negative to the
    sink; edges: undirected (i, j, capacity). Augments along shortest paths by levels, with current arcs."""
    n = len(costs)
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[float] = []

    def join(i: int, j: int, forth: float, back: float) -> None:
        head[i].append(len(to))
        to.append(j)
        cap.append(forth)
        head[j].append(len(to))
        to.append(i)
        cap.append(back)

    for i, c in enumerate(costs):
        if c > 0:
            join(s, i, c, 0.0)
        elif c < 0:
            join(i, t, -c, 0.0)
    for i, j, c in edges:
        join(i, j, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s], queue = 0, [s]
        for u in queue:
            for e in head[u]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        arc = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if cap[e] <= 1e-9)
                u = to[path[k] ^ 1]
                del path[k:]
            while arc[u] < len(head[u]):
                e = head[u][arc[u]]
                if cap[e] > 1e-9 and level[to[e]] == level[u] + 1:
                    break
                arc[u] += 1
            if arc[u] < len(head[u]):
                path.append(head[u][arc[u]])
                u = to[path[-1]]
            elif path:
                u = to[path.pop() ^ 1]
                arc[u] += 1
            else:
                break


def label(blocks: list[Block], nodes: list[Node]) -> list[bool]:
    """True for content."""
    of = contexts(blocks, nodes)
    context = [of[b.node] for b in blocks]
    costs = [score(b, nodes[b.node].tag, c) for b, c in zip(blocks, context, strict=True)]
    if all(c > 0 for c in costs) or all(c <= 0 for c in costs):
        return [c > 0 for c in costs]  # nothing to cut
    edges = []
    last: dict[tuple[int, float], int] = {}
    for i, b in enumerate(blocks):
        if i:
            near = SMOOTH / distance(blocks[i - 1].node, b.node, nodes)
            edges.append((i - 1, i, near if context[i - 1] == context[i] else near * ACROSS))
        here = (nodes[b.node].parent, context[i])
        if last.get(here, i) < i - 1:  # the one before under this parent, with others between them
            edges.append((last[here], i, SMOOTH))
        last[here] = i
    return minimum_cut(costs, edges)


def main_text(page: str | None) -> str:
    """Content blocks in page order, joined by a blank line; empty for null, empty and all-boilerplate pages."""
    if not page:
        return ""
    blocks, nodes = parse(page)
    return "\n\n".join(b.text for b, keep in zip(blocks, label(blocks, nodes), strict=True) if keep)


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """pages with the column of whole html replaced by its main text (a column of that name is replaced).

    A null or empty page, and one without content, gives an empty text. Malformed markup is tolerated: unclosed and
    stray tags, quotes that never close; raw-text elements end at their own end tag only; a tag that never ends is text.
    Pages are read whole, in time proportional to their length. All other columns are kept; repeated rows stay, each
    with its text; an empty table gives no rows.
    """
    rest = [c for c in pages.columns if c.lower() not in (html.lower(), text.lower())]
    rows = pages.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{html}`").cast("string").alias(text))
    at = len(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), 512):
                part = b.slice(k, 512)
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array([main_text(p.as_py()) for p in part.column(at)], pa.string())], names=b.schema.names)

    return rows.mapInArrow(run, T.StructType(rows.schema.fields))
