"""Main text of web pages by a minimum cut between content and boilerplate."""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's elements by what they mean for a page's text.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SILENT = {"script", "style", "noscript", "template", "head", "title", "svg", "iframe", "object", "select", "textarea", "canvas", "audio", "video"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "math", "mrow", "mi", "mo", "mn", "ms", "mtext", "msup", "msub", "mfrac", "msqrt"}
HEAD_TAGS = {"html", "head", "title", "meta", "link", "base", "script", "style", "noscript", "template"}
BOILERPLATE = {"nav", "aside", "footer", "form", "dialog", "menu", "button", "fieldset"}
CONTENT = {"article", "main"}
#: An open element of the first kind ends when one of its own kind starts.
IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: Words in a class, id or role that name boilerplate.
MARKERS = set("ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices alert menu navbar nav navigation breadcrumb breadcrumbs sidebar sidenav aside complementary footer contentinfo header masthead comment comments commentlist respond replies disqus share sharing social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay widget form search pagination pager skip toolbar".split())

#: What the classifier looks at in a block, and its weights, in log-odds of content, before any page is seen.
FEATURES = ("bias", "length", "links", "heading", "copyright", "sentence")
PRIOR_WEIGHTS = (0.1, 2.0, -3.5, 0.5, -2.0, 0.0)
#: The weights are fitted on the marked blocks of at most so many pages of at most so many bytes, drawn by a hash; they count as FIT_EVIDENCE blocks
#: against a normal prior of variance one around PRIOR_WEIGHTS, so few pages change little.
FIT_PAGES, FIT_BYTES, FIT_EVIDENCE, FIT_STEPS = 256, 1_000_000, 40.0, 20
#: An element that is marked as content, soft or hard boilerplate is a node of its own, tied to its terminal by the first
#: number and to each block in it by the second.
EVIDENCE = {"content": (20.0, 5.0), "soft": (20.0, 6.0), "hard": (40.0, 14.0)}
#: Capacity between neighbours in the page, and more for the same parent or grandparent. All capacities are in hundredths.
NEXT, SAME_PARENT, SAME_GRANDPARENT, UNIT = 0.3, 0.6, 0.3, 100


@dataclass
class Block:
    text: str
    linked: int
    tag: str
    parent: int
    grandparent: int
    state: str
    #: The marked element that gives the block its state; -1 for none.
    marked: int = -1


class _Blocks(HTMLParser):
    """Text blocks of a page with where they stand. States pass down: silent, hard and soft boilerplate, content."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        #: (tag, state, number, number of the marked element) of what is open; where the elements that are not inline stand.
        self.stack: list[tuple[str, str, int, int]] = [("", "", 0, -1)]
        self.outer = [0]
        self.open: Counter[str] = Counter()
        self.made = 0
        self.text: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        if self.text:
            if text := " ".join("".join(self.text).split()):
                tag, state, own, marked = self.stack[self.outer[-1]]
                up = [self.stack[k][2] for k in self.outer[-3:-1]]
                self.blocks.append(Block(text, self.linked, tag, up[-1] if up else own, up[-2] if len(up) > 1 else -1, state, marked))
            self.text, self.linked = [], 0

    def _state(self, tag: str, attrs: list[tuple[str, str | None]]) -> str:
        state = self.stack[-1][1]
        if tag in SILENT or state == "silent":
            return "silent"
        own = dict(attrs)
        hidden = "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in (own.get("style") or "").replace(" ", "")
        if state == "hard" or hidden or tag in BOILERPLATE or tag == "header" and state != "content":
            return "hard"
        names = f"{own.get('class') or ''} {own.get('id') or ''} {own.get('role') or ''}"
        content = tag in CONTENT or own.get("role") in ("main", "article")
        if content:
            named = names.lower().split()
        else:
            named = re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", names).lower())
        if state == "soft" or tag not in ("html", "body", "main") and not MARKERS.isdisjoint(named) and not (state == "content" and tag == "header"):
            return "soft"
        return "content" if content else state

    def _pop(self, to: int) -> None:
        self.open.subtract(x[0] for x in self.stack[to:])
        del self.stack[to:]
        while self.outer[-1] >= to:
            self.outer.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INLINE:
            self.flush()
        if self.open["head"] and tag not in HEAD_TAGS:
            self._close("head")
        around = self.stack[self.outer[-1]][0]
        if around in IMPLIED.get(tag, ()) or around == "p" and tag in ENDS_P:
            self._pop(self.outer[-1])
        if tag in VOID:
            return
        self.made += 1
        _, before, _, marked = self.stack[-1]
        state = self._state(tag, attrs)
        if tag not in INLINE:
            self.outer.append(len(self.stack))
        self.stack.append((tag, state, self.made, self.made if state != before and state in EVIDENCE else marked))
        self.open[tag] += 1

    def _close(self, tag: str) -> None:
        if self.open[tag] > 0:
            k = len(self.stack) - 1
            while self.stack[k][0] != tag:
                k -= 1
            self._pop(k)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        self._close(tag)

    def handle_data(self, data: str) -> None:
        if self.stack[-1][1] != "silent":
            self.text.append(data)
            if self.open["a"] > 0:
                self.linked += len(data.strip())


def blocks_of(html: str | None) -> list[Block]:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return [b for b in parser.blocks if b.state != "silent"]


def block_features(block: Block) -> tuple[float, ...]:
    """FEATURES of a block by itself, whatever stands around it."""
    words = block.text.count(" ") + 1
    copyright_ = block.text.startswith(("©", "(c)", "Copyright"))
    return (1.0, min(1.0, words / 15), min(1.0, block.linked / len(block.text)), float(block.tag in ("h1", "h2", "h3")), float(copyright_), float(words > 3 and block.text[-1] in ".!?\"”»"))


def log_odds(block: Block, weights: Sequence[float] = PRIOR_WEIGHTS) -> float:
    """How likely a block is content, by itself."""
    return sum(w * x for w, x in zip(weights, block_features(block), strict=True))


def fit_classifier(htmls: Iterable[str | None]) -> tuple[float, ...]:
    """Weights of the block classifier from pages: blocks under content marks against those under boilerplate marks.

    Logistic regression by Newton's steps, drawn towards PRIOR_WEIGHTS, which it returns if no block is marked.
    """
    rows, labels = [], []
    for html in htmls:
        for b in blocks_of(html):
            if b.state:
                rows.append(block_features(b))
                labels.append(b.state == "content")
    prior = np.array(PRIOR_WEIGHTS)
    if not rows:
        return PRIOR_WEIGHTS
    x, y, w = np.array(rows), np.array(labels, float), prior.copy()
    scale = np.where(y == 1, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, len(y) - y.sum())) * FIT_EVIDENCE
    for _ in range(FIT_STEPS):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (scale * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (scale * (y - p)) - (w - prior))
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w.round(6).tolist())


def terminal_capacities(z: float) -> tuple[int, int]:
    """(to content, to boilerplate) for the log-odds z: the costs, -log p, of the other label."""
    softplus = lambda x: max(x, 0.0) + math.log1p(math.exp(-abs(x)))
    return round(UNIT * softplus(z)), round(UNIT * softplus(-z))


def evidence(blocks: list[Block]) -> tuple[list[int], list[int], list[tuple[int, int, int]]]:
    """Capacities of the nodes of marked elements, numbered after the blocks, and their edges to the blocks inside."""
    number: dict[int, int] = {}
    source, sink, edges = [], [], []
    for i, b in enumerate(blocks):
        if b.state in EVIDENCE:
            terminal, tie = EVIDENCE[b.state]
            if b.marked not in number:
                number[b.marked] = len(blocks) + len(number)
                source.append(round(UNIT * terminal) if b.state == "content" else 0)
                sink.append(0 if b.state == "content" else round(UNIT * terminal))
            edges.append((i, number[b.marked], round(UNIT * tie)))
    return source, sink, edges


def smoothness_edges(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """(i, j, capacity): each block with the next, and with the last one before it that has the same parent element."""
    edges, last = [], {}
    for j, b in enumerate(blocks):
        i = last.get(b.parent)
        if j:
            a = blocks[j - 1]
            near = SAME_PARENT if a.parent == b.parent else SAME_GRANDPARENT if a.grandparent == b.grandparent else 0.0
            edges.append((j - 1, j, round(UNIT * (NEXT + near))))
        if i is not None and i != j - 1:
            edges.append((i, j, round(UNIT * SAME_PARENT)))
        last[b.parent] = j
    return edges


def minimum_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay with the source, given capacities from the source, to the sink, and both ways between nodes.

    Maximum flow by levels and blocking flows. What source and sink can exchange over one node is taken at once.
    """
    n = len(source)
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def link(a: int, b: int, forth: int, back: int) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(forth)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, (s, t) in enumerate(zip(source, sink, strict=True)):
        if s > t:
            link(n, i, s - t, 0)
        elif t > s:
            link(i, n + 1, t - s, 0)
    for a, b, c in edges:
        link(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[n] = 0
        queue = deque([n])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[n + 1] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        a = n
        while True:
            if a == n + 1:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if not room[e])
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[a] < len(head[a]):
                e = head[a][at[a]]
                if room[e] and level[to[e]] == level[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(head[a]):
                path.append(head[a][at[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                at[a] += 1
            else:
                break


def labels(blocks: list[Block], weights: Sequence[float] = PRIOR_WEIGHTS) -> list[bool]:
    """Which blocks are content, by the minimum cut. Of equal cuts it is the one with the fewest blocks."""
    source, sink = (list(x) for x in zip(*(terminal_capacities(log_odds(b, weights)) for b in blocks), strict=True))
    more_source, more_sink, ties = evidence(blocks)
    return minimum_cut(source + more_source, sink + more_sink, smoothness_edges(blocks) + ties)[: len(blocks)]


def main_text(html: str | None, weights: Sequence[float] = PRIOR_WEIGHTS) -> str:
    """The content blocks of a page in page order, joined by one space; empty for null, empty and text-free pages."""
    blocks = blocks_of(html)
    return " ".join(b.text for b, k in zip(blocks, labels(blocks, weights), strict=True) if k) if blocks else ""


def fitted(pages: DataFrame, fit_pages: int = FIT_PAGES) -> tuple[float, ...]:
    """fit_classifier over at most fit_pages different pages of at most FIT_BYTES bytes, drawn by a hash of the html."""
    drawn = pages.select(F.col("html").cast("string").alias("html")).where(F.octet_length("html") <= FIT_BYTES).select("html", F.xxhash64("html").alias("h"))
    chosen = [r.h for r in drawn.select("h").distinct().orderBy("h").limit(fit_pages).collect()]
    cut = max(chosen, default=0)
    parsed = drawn.where(F.col("h") <= cut).dropDuplicates(["h"]).select("h", "html")
    return fit_classifier(r.html for r in parsed.orderBy("h").toLocalIterator())


def extract_main_text(pages: DataFrame, weights: Sequence[float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars: one row per page, rows that repeat included, with the weights given or fitted to the pages.

    Extraction is map-only and reads whole pages of any length and depth. Null and empty html give an empty text, null ids
    and urls stay, other columns are not read, an empty table gives no rows.
    """
    weights = fitted(pages) if weights is None else tuple(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [main_text(h, weights) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
