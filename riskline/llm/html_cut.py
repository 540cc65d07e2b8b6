"""Main text of web pages by minimum-cut labelling of their blocks.

A page is split into blocks (runs of text between block-level tags). The graph
has a node for each block and for each element that holds one. A linear
classifier over a block's own text (length, sentence end, links, tag) gives it a
cost of being called content and a cost of being called boilerplate; they become
capacities from the source and to the sink. What an element is called says
nothing about a block by itself: it is a capacity of the element's node (towards
content in an article, towards boilerplate in menus, footers, adverts and the
like). A block is tied to its element, an element to the one around it
(tightly for paragraphs and list items, loosely for sections) and to its
neighbour in the text. The minimum cut is the cheapest labelling; blocks on the
source side are the main text. So a short line follows the paragraphs around
it, a long sentence the advert that holds it, and pages without telling names
are split by their text alone.

Defined results: null or empty html and pages without content give an empty
text; unclosed tags end with their container; repeated rows are labelled one by
one; an empty table gives no rows. White space is what ``str.split`` splits on.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|math|iframe|object|textarea|select|title|head(?=[\s>]))"
    r"\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<attrs>(?:=\s*+(?:\"[^\"]*+\"?|'[^']*+'?)|[^>])*+)(?:>|\Z)",
    re.DOTALL | re.IGNORECASE)
ATTR = re.compile(r"\b(?:class|id|role)\s*+=\s*+(\"[^\"]*+|'[^']*+|[^\s>]++)", re.IGNORECASE)
HINT = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp "
                   "small span strike strong sub sup time tt u var wbr img picture source".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never the article's.
BARRED = frozenset("nav aside footer form menu dialog button fieldset option".split())
HINTS = frozenset("nav navbar navigation menu footer sidebar aside ad ads advert advertisement sponsor sponsored "
                  "promo banner cookie cookies consent notice popup modal overlay subscribe newsletter signup "
                  "login search share sharing social related recommended comment comments disqus reply replies "
                  "breadcrumb breadcrumbs pagination pager widget toolbar masthead copyright legal".split())
CLOSES = {"p": ("p",), "li": ("li", "p"), "dt": ("dd", "dt", "p"), "dd": ("dd", "dt", "p"),
          "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p")}
#: Weights of the linear block classifier, in nats towards content.
WEIGHTS = {"bias": -1.2, "paragraph": 0.5, "heading": 0.8, "words": 2.4, "sentence": 0.5, "links": -3.0,
           "list_links": -1.5}
#: A block's text never outweighs its tie to an element whose kind is known.
STRONGEST = 2.4
#: Capacities of the edges: block or text element to what holds it, section to section, neighbours in the text.
TIED, LOOSE, ADJACENT = 3.0, 0.2, 0.1
#: Capacity of an element whose kind is known.
KNOWN = 1e7
TEXT_ELEMENTS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th tbody thead blockquote pre figcaption".split())


class Block:
    __slots__ = ("text", "element", "tag", "linked")

    def __init__(self, text, element, tag, linked):
        self.text, self.element, self.tag, self.linked = text, element, tag, linked


class Element:
    """An element that is not inline: its parent's number, its name and its kind (1 article, -1 boilerplate, 0 not known)."""

    __slots__ = ("parent", "name", "kind")

    def __init__(self, parent, name, kind):
        self.parent, self.name, self.kind = parent, name, kind


def blocks_of(page: str) -> tuple[list[Block], list[Element]]:
    """The page's text blocks in order, and its elements; an element's kind holds for all inside it."""
    out: list[Block] = []
    elements = [Element(-1, "", 0)]
    # (name, boilerplate, article, number of the innermost element that is not inline)
    stack = [("", False, False, 0)]
    parts: list[str] = []
    link_chars, in_link = 0, 0

    def flush():
        nonlocal link_chars
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                holder = stack[-1][3]
                out.append(Block(text, holder, elements[holder].name, min(1.0, link_chars / len(text))))
            parts.clear()
        link_chars = 0

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at:m.start()]
            parts.append(piece)
            if in_link:
                link_chars += len(piece.strip())
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            parts.append(" ")
            continue
        inline = name in INLINE
        if not inline:
            flush()
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if inline and stack[k][0] not in INLINE:
                    break
            if name == "a":
                in_link = 0
            continue
        if name == "a":
            in_link = 1
        if name in VOID or m["attrs"].rstrip().endswith("/"):
            continue
        shut = CLOSES.get(name) or (("p",) if not inline else ())
        if shut:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in shut:
                    del stack[k:]
                    break
                if stack[k][0] not in INLINE:
                    break
        _, barred, article, number = stack[-1]
        barred = barred or name in BARRED or (name == "header" and not article) or any(
            w.lower() in HINTS for a in ATTR.findall(m["attrs"]) for w in HINT.findall(a))
        article = article or name in ("article", "main")
        if not inline:
            elements.append(Element(number, name, -1 if barred else int(article)))
            number = len(elements) - 1
        stack.append((name, barred, article, number))
    parts.append(page[at:])
    flush()
    return out, elements


def content_score(b: Block) -> float:
    """Nats in favour of content, by the block's own text."""
    w = WEIGHTS
    words = b.text.count(" ") + 1
    score = (w["bias"] + w["paragraph"] * (b.tag == "p") + w["heading"] * (b.tag in ("h1", "h2", "h3", "h4"))
             + w["words"] * min(words, 30) / 30 + w["sentence"] * b.text.endswith((".", "!", "?", "。"))
             + w["links"] * b.linked + w["list_links"] * (b.tag == "li" and b.linked > 0.5))
    return max(-STRONGEST, min(STRONGEST, score))


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source side of a minimum cut (undirected edges).

    Flow that a node can pass straight from source to sink is taken at once; the
    rest moves in phases, each a blocking flow along the levels of one search
    from all nodes with excess, so large pages take few passes over their graph.
    The last search meets no sink: what it reaches is the source side.
    """
    n = len(source)
    excess = [s - t for s, t in zip(source, sink)]
    graph: list[list[int]] = [[] for _ in range(n)]
    to, cap = [], []
    for a, b, c in edges:
        graph[a].append(len(to))
        to.append(b)
        cap.append(c)
        graph[b].append(len(to))
        to.append(a)
        cap.append(c)
    while True:
        queue = [v for v in range(n) if excess[v] > 1e-9]
        starts, level, found = len(queue), [-1] * n, False
        for v in queue:
            level[v] = 0
        for u in queue:
            for e in graph[u]:
                v = to[e]
                if level[v] < 0 and cap[e] > 1e-9:
                    level[v] = level[u] + 1
                    queue.append(v)
                    found = found or excess[v] < -1e-9
        if not found:
            return [x >= 0 for x in level]
        arc = [0] * n
        for s in queue[:starts]:
            path, u = [], s
            while excess[s] > 1e-9:
                if excess[u] < -1e-9:
                    push = min(excess[s], -excess[u], min(cap[e] for e in path))
                    for e in path:
                        cap[e] -= push
                        cap[e ^ 1] += push
                    excess[s] -= push
                    excess[u] += push
                    path, u = [], s
                    continue
                way = graph[u]
                while arc[u] < len(way) and not (cap[way[arc[u]]] > 1e-9 and level[to[way[arc[u]]]] == level[u] + 1):
                    arc[u] += 1
                if arc[u] < len(way):
                    path.append(way[arc[u]])
                    u = to[path[-1]]
                elif path:  # no way on from here in this phase
                    level[u] = -1
                    u = to[path.pop() ^ 1]
                else:
                    break


def label_blocks(blocks: list[Block], elements: list[Element]) -> list[bool]:
    """Content or not, by the minimum cut of the page's graph."""
    score = [content_score(b) for b in blocks]
    edges = [(k, k + 1, ADJACENT) for k in range(len(blocks) - 1)]
    node: dict[int, int] = {}  # element -> its node, made when a block below it is met
    for k, b in enumerate(blocks):
        low, up, tie = k, b.element, TIED
        while up >= 0:
            known = up in node
            if not known:
                node[up] = len(score)
                score.append(KNOWN * elements[up].kind)
            edges.append((low, node[up], tie))
            if known:
                break
            low, tie = node[up], TIED if elements[up].name in TEXT_ELEMENTS else LOOSE
            up = elements[up].parent
    side = min_cut([max(x, 0.0) for x in score], [max(-x, 0.0) for x in score], edges)
    return side[:len(blocks)]


def main_text(page: str | None) -> str:
    blocks, elements = blocks_of(page or "")
    return "\n\n".join(b.text for b, keep in zip(blocks, label_blocks(blocks, elements)) if keep)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html)."""
    d = pages.select("page_id", "url", "html")

    def run(batches):
        for b in batches:
            text = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string())],
                                             ["page_id", "url", "text"])

    schema = d.drop("html").schema.add("text", "string")
    return d.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))
