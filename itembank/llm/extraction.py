"""Main text of web pages by minimum-cut labelling of their text blocks."""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itembank.llm.common import slices, whole_text

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|svg|textarea|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|<[!?/][^>]*>"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)

#: Elements that begin and end blocks, that have no end tag, and that are never main text.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("head button select option form fieldset label legend dialog".split())
#: closed by the next block, or by the next element of their own kind
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
TAGS = {"article": 2.5, "main": 2.0, "nav": -6.0, "footer": -6.0, "aside": -6.0, "header": -3.0, "menu": -4.0}
ROLES = {"main": 2.0, "article": 2.5, "navigation": -6.0, "banner": -4.0, "contentinfo": -6.0, "complementary": -6.0, "search": -6.0, "alert": -6.0, "dialog": -6.0, "menu": -6.0}
_BAD = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|sidebar|side|foot\w*|masthead|top-?bar|comments?|comment-\w+|commentlist|"
    r"disqus|repl(?:y|ies)|respond|share\w*|social\w*|related|recommend\w*|cookies?|consent|gdpr|notices?|alerts?|warning|popup|modal|overlay|newsletter|"
    r"subscri\w+|signup|login|search|breadcrumbs?|pagination|pager|widget\w*|toolbar|copyright|legal|disclaimer|tags?|meta|byline-links|hidden)(?:$|[\s_-])",
    re.I,
)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article\w*|content|post|entry|story|main|body|text|prose)(?:$|[\s_-])", re.I)
_HEADER = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NEVER_COST, EDGE_NEXT, EDGE_SIBLING = 1e6, 0.4, 0.8


@dataclass
class _Element:
    tag: str
    parent: int
    score: float  # evidence of the element and those around it
    never: bool
    in_article: bool


@dataclass
class Block:
    parent: int
    grand: int
    tag: str
    score: float
    never: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _evidence(tag: str, attrs: str, outer: _Element) -> _Element:
    score, never = outer.score, outer.never or tag in NEVER
    in_article = outer.in_article or tag in ("article", "main")
    if tag in TAGS and not (tag == "header" and outer.in_article):
        score += TAGS[tag]
    if attrs:
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                if _BAD.search(value) or (_HEADER.search(value) and not outer.in_article):
                    score -= 6.0
                elif _GOOD.search(value):
                    score += 1.0
                    in_article = in_article or bool(re.search(r"article|post|entry|story", value, re.I))
            elif name == "role":
                score += ROLES.get(value.lower(), 0.0)
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
                never = True
    return _Element(tag, 0, score, never, in_article)


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order, with what their elements say about them.

    A lenient reading: comments and raw elements are skipped, also unclosed ones; a block ends
    an open paragraph; an end tag without its start is ignored, and one that skips open
    elements closes them.
    """
    elements = [_Element("", -1, 0.0, False, False)]
    stack, done = [0], []
    current: Block | None = None
    links = 0

    def flush() -> None:
        nonlocal current
        if current is not None:
            current.text = " ".join(entities.unescape("".join(current.parts)).split())
            if current.text:
                done.append(current)
        current = None

    def close(at: int) -> None:
        nonlocal links
        for number in stack[at:]:
            links -= elements[number].tag == "a"
        del stack[at:]

    for token in _TOKEN.finditer(page):
        text = token["text"]
        if text is not None:
            if current is None:
                if text.isspace():
                    continue
                holder = next(n for n in reversed(stack) if elements[n].tag in BLOCKS or n == 0)
                e = elements[stack[-1]]
                current = Block(holder, elements[holder].parent, elements[holder].tag, e.score, e.never)
            current.parts.append(text)
            if links:
                current.linked += len(text)
            continue
        tag = token["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            flush()
        if token["end"]:
            for at in range(len(stack) - 1, 0, -1):
                open_tag = elements[stack[at]].tag
                if open_tag == tag:
                    close(at)
                    break
                if tag not in BLOCKS and open_tag in BLOCKS:
                    break  # an inline end tag does not reach out of its block
            continue
        if tag == "br" and current is not None:
            current.parts.append(" ")
        if tag in VOID:
            continue
        if tag in BLOCKS:
            over = CLOSES.get(tag, ())
            for at in range(len(stack) - 1, 0, -1):
                open_tag = elements[stack[at]].tag
                if open_tag == "p" or open_tag in over:
                    close(at)
                    if open_tag == "p":
                        continue
                    break
                if open_tag in BLOCKS and open_tag not in ("p",):
                    break
        made = _evidence(tag, token["attrs"], elements[stack[-1]])
        made.parent = stack[-1]
        elements.append(made)
        stack.append(len(elements) - 1)
        links += tag == "a"
    flush()
    return done


def block_cost(block: Block) -> float:
    """Log odds of being main text, from the block's elements, length, links and ending."""
    if block.never:
        return -NEVER_COST
    words = block.text.count(" ") + 1
    cost = 0.6 + block.score + (1.5 if words >= 25 else 0.8 if words >= 10 else 0.2 if words >= 5 else -0.4)
    if block.linked * 2 > len(block.text):
        cost -= 2.5
    if block.text[-1] in ".!?…":
        cost += 0.4
    if block.tag in ("h1", "h2", "h3", "h4"):
        cost += 0.5
    if "©" in block.text or "all rights reserved" in block.text.lower():
        cost -= 2.0
    return cost


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness: blocks in a row, and each block with the next one under the same element and the same outer element."""
    edges = [(i, i + 1, EDGE_NEXT) for i in range(len(blocks) - 1) if blocks[i].parent == blocks[i + 1].parent or blocks[i].grand == blocks[i + 1].grand]
    for key in ("parent", "grand"):
        last: dict[int, int] = {}
        for i, block in enumerate(blocks):
            place = getattr(block, key)
            if place in last:
                edges.append((last[place], i, EDGE_SIBLING))
            last[place] = i
    return edges


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source side of a minimum cut.

    A node's positive cost is its capacity from the source, a negative one that to the sink.
    Maximum flow by level graphs and blocking flows.
    """
    n = len(costs)
    source, sink = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def join(a: int, b: int, there: float, back: float) -> None:
        graph[a].append(len(to))
        to.append(b)
        room.append(there)
        graph[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, cost in enumerate(costs):
        if cost > 0:
            join(source, i, cost, 0.0)
        elif cost < 0:
            join(i, sink, -cost, 0.0)
    for a, b, weight in edges:
        join(a, b, weight, weight)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        todo = deque([source])
        while todo:
            a = todo.popleft()
            for e in graph[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    todo.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt = [0] * (n + 2)
        path: list[int] = []
        at = source
        while True:
            if at == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                keep = next(k for k, e in enumerate(path) if room[e] <= tiny)
                del path[keep:]
                at = to[path[-1]] if path else source
                continue
            while nxt[at] < len(graph[at]):
                e = graph[at][nxt[at]]
                if room[e] > tiny and level[to[e]] == level[at] + 1:
                    break
                nxt[at] += 1
            else:
                if at == source:
                    break
                level[at] = -1
                at = to[path.pop() ^ 1]
                continue
            path.append(e)
            at = to[e]


def label_blocks(blocks: list[Block]) -> list[bool]:
    costs = [block_cost(b) for b in blocks]
    return minimum_cut(costs, edges_of(blocks)) if blocks else []


def main_text(page: str) -> str:
    """The blocks labelled as content, joined by line feeds; empty if there are none."""
    blocks = blocks_of(page)
    return "\n".join(b.text for b, content in zip(blocks, label_blocks(blocks), strict=True) if content)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row.

    Null and empty pages, and pages without content, have an empty text; repeated rows and null
    ids are read like others. Nothing is shuffled, and a batch is bounded in bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(page) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            })

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", whole_text("html").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
