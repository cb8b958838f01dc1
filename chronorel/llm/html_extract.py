"""Main-text extraction from HTML by minimum-cut labelling.

A page becomes a list of text blocks in page order; what a reader does not see
(scripts, styles, hidden elements) makes no block.  A logistic classifier gives
each block the costs of calling it content or boilerplate: the terminal
capacities of a flow network.  Blocks that follow each other, and a block and
the one before it in the same container, are tied by smoothness edges whose
weight depends on their distance in the document tree.  The minimum cut labels
all blocks of the page at once, so a block that looks odd for itself follows its
surroundings unless its own evidence outweighs them.

Containers are properly nested, hence these edges never cross and some node
always has at most two neighbours.  Taking such nodes out one by one and adding
what they cost to the edge between their neighbours finds the same cut as
augmenting paths do, in time linear in the blocks (``min_cut``).

Costs and edge weights are learned from a bounded sample of blocks.  Blocks are
labelled by containers that tell their role (article, nav, footer, ...), but on
half of the pages the classifier does not see these roles and must tell blocks
by their text and element; edge weights are the log-odds that two blocks at a
tree distance have the same label.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct_sample, ship_package
from .shingles import lean

#: Bounds of the training sample: whole distinct pages parsed, and blocks of them that reach the driver (by hash).
TRAIN_PAGES, TRAIN_BLOCKS = 400, 40_000
#: Terminal costs are clipped to this many nats, edge weights to SMOOTH: no single mark is beyond the reach of the rest.
CLIP, SMOOTH, DISTANCES = 6.0, 2.0, 5
#: Pull of the prior weights for each block: pages of one make separate perfectly, which must not make one mark all there is.
HOLD = 0.01

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)(?:>|\Z)", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z)")
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_TELLING = re.compile(r"class|id|role|style|hidden", re.I)
_PART = re.compile(r"[a-z]+")
_UNSEEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: Elements whose text is no markup, and elements that show no text of their own.
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
SILENT = frozenset("svg math object canvas audio video map".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr input".split())
TEXTUAL = INLINE | SILENT  # do not divide a text
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("html body main article section div nav header footer aside form ul ol dl table tbody thead tfoot tr td th figure blockquote fieldset details menu dialog address select button".split())
#: Open elements that a new block ends (a paragraph, where none are given), and containers that a table part ends.
_HEADINGS = ("p", "h1", "h2", "h3", "h4", "h5", "h6")
ENDS = {"li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), **{h: _HEADINGS for h in _HEADINGS[1:]}}
ENDS_CONTAINERS = {"td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, **{t: {"td", "th", "tr", "thead", "tbody"} for t in ("tbody", "tfoot")}}
GOOD_TAGS, BAD_TAGS = frozenset({"article", "main"}), frozenset("nav footer aside form menu dialog select button fieldset".split())
GOOD_ROLES, BAD_ROLES = frozenset({"article", "main"}), frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu".split())
GOOD_NAMES = frozenset("article content post entry story main body text prose page".split())
BAD_NAMES = frozenset(
    "nav navbar navigation menu header masthead footer foot sidebar side widget widgets ad ads advert advertisement adverts banner promo promotion sponsor sponsored cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond breadcrumb breadcrumbs pagination pager login search copyright legal toolbar skip tags meta byline".split()
)
#: Parts of a class name that say nothing, those of frames around everything, and names that an article may bear inside.
PLAIN_NAMES = frozenset("box block area section list item items inner outer bar unit slot site global top bottom form links link text title the".split())
FRAME_NAMES = frozenset("wrap wrapper container layout grid".split())
INNER_NAMES = frozenset("header meta tags byline".split())


@dataclass(slots=True)
class Block:
    """A text, its element, its container's number and depth, the marks of its ancestors and the tree distance to the block before."""

    text: str
    tag: str
    parent: int
    depth: int
    good: int
    bad: int
    named_good: int
    named_bad: int
    link_chars: int
    gap: int


def name_marks(names: str, inside: bool) -> tuple[int, int]:
    """(content, boilerplate) marks of a class or id value: whole names count, not words within longer names."""
    good = bad = 0
    for name in names.lower().split():
        parts = set(_PART.findall(name))
        known = parts - PLAIN_NAMES - FRAME_NAMES
        if not known or known - GOOD_NAMES - BAD_NAMES:
            continue
        against = known & BAD_NAMES
        if not against:
            good = 1
        elif not (known & GOOD_NAMES and parts & FRAME_NAMES) and not (inside and against <= INNER_NAMES):
            bad = 1
    return good, bad


class _Parser:
    """Builds the blocks of a page; every open element is on the stack with the marks that its text inherits."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        # tag, container number, container depth, good, bad, named_good, named_bad, unseen
        self.stack: list[tuple] = [("", 0, 0, 0, 0, 0, 0, 0)]
        self.at: dict[str, list[int]] = {}
        self.containers = [0]
        self.text: list[str] = []
        self.numbers, self.links = 1, 0
        self.last_depth, self.low = 0, 0
        self.foreign = 0  # open SILENT elements: what is inside is no document

    def flush(self) -> None:
        if self.text:
            joined = " ".join("".join(map(html.unescape, self.text)).split())
            self.text.clear()
            if joined:
                tag, number, depth, good, bad, named_good, named_bad, _ = self.stack[-1]
                k = len(self.stack) - 1
                while self.stack[k][0] in INLINE:
                    k -= 1
                gap = self.last_depth + depth - 2 * self.low
                self.blocks.append(Block(joined, self.stack[k][0], number, depth, good, bad, named_good, named_bad, min(self.links, len(joined)), gap))
                self.last_depth = self.low = depth
        self.links = 0

    def add(self, piece: str) -> None:
        if not self.stack[-1][-1]:
            self.text.append(piece)
            if self.at.get("a"):
                self.links += len(piece.strip())

    def pop_to(self, size: int) -> None:
        while len(self.stack) > size:
            tag = self.stack.pop()[0]
            self.at[tag].pop()
            self.foreign -= tag in SILENT
            if self.containers[-1] == len(self.stack):
                self.containers.pop()
                self.low = min(self.low, self.stack[-1][2])

    def open(self, tag: str, attributes: str) -> None:
        if tag not in TEXTUAL and not self.foreign:
            self.flush()
            while self.stack[self.containers[-1]][0] in ENDS_CONTAINERS.get(tag, ()):
                self.pop_to(self.containers[-1])
            for ended in ENDS.get(tag, ("p",)):
                self.end(ended)
        elif tag == "a":
            self.end("a")
        _, number, depth, good, bad, named_good, named_bad, unseen = self.stack[-1]
        inside = good > 0
        good += tag in GOOD_TAGS
        bad += tag in BAD_TAGS or (tag == "header" and not inside)
        unseen += tag in SILENT
        self.foreign += tag in SILENT
        if attributes and _TELLING.search(attributes):
            for a in _ATTRIBUTE.finditer(attributes):
                what, value = a[1].lower(), (a[2] or "").strip("\"'").lower()
                if what == "role":
                    good, bad = good + (value in GOOD_ROLES), bad + (value in BAD_ROLES)
                elif what in ("class", "id") and tag not in ("html", "body"):
                    g, b = name_marks(value, inside)
                    named_good, named_bad = named_good + g, named_bad + b
                elif what == "hidden" or (what == "aria-hidden" and value == "true") or (what == "style" and _UNSEEN_STYLE.search(value)):
                    unseen += 1
        if tag in CONTAINERS:
            number, depth = self.numbers, depth + 1
            self.numbers += 1
            self.containers.append(len(self.stack))
        self.at.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, number, depth, good, bad, named_good, named_bad, unseen))

    def end(self, tag: str) -> None:
        """Ends an open element: text elements within their container, containers wherever they were opened."""
        held = self.at.get(tag)
        if held and (tag in CONTAINERS or held[-1] > self.containers[-1]):
            self.pop_to(held[-1])

    def close(self, tag: str) -> None:
        if tag not in TEXTUAL and not self.foreign:
            self.flush()
        self.end(tag)


def parse_blocks(page: str | None) -> list[Block]:
    """Text blocks in page order."""
    page = page or ""
    p = _Parser()
    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            p.add(page[at:])
            break
        if lt > at:
            p.add(page[at:lt])
        m = _TOKEN.match(page, lt) or _LOOSE.match(page, lt)
        if not m:
            p.add("<")
            at = lt + 1
            continue
        at = m.end()
        if not m.lastindex:
            continue
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        if closing:
            p.close(tag)
        elif tag in RAW:
            over = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = over.end() if over else end
        elif tag in VOID:
            if tag == "br":
                p.add(" ")
            elif tag not in TEXTUAL:
                p.flush()
        elif not (tag in SILENT and attributes.endswith("/")):
            p.open(tag, attributes)
    p.flush()
    return p.blocks


def features(b: Block, hidden: bool = False) -> list[float]:
    """What the classifier sees of a block; ``hidden`` leaves out the roles and names of its containers.

    A block that its containers mark as boilerplate has no other features:
    adverts and comments read like the article.
    """
    if not hidden and (b.bad or b.named_bad):
        return [0.0, float(min(b.bad, 2)), 0.0, float(min(b.named_bad, 2)), 1.0, *[0.0] * 8]
    n = len(b.text)
    words = b.text.count(" ") + 1
    ends = sum(b.text.count(c) for c in ".!?…")
    return [
        float(b.good > 0 and not hidden),
        0.0,
        float(b.named_good > 0 and not hidden),
        0.0,
        1.0,
        b.link_chars / n,
        math.log1p(words) / 3,
        float(ends > 0),
        min(ends / words, 0.5) * 2,
        float(b.tag in ("p", "blockquote", "pre")),
        float(b.tag in ("h1", "h2", "h3", "h4")),
        float(b.tag in ("li", "dd", "dt", "ul")),
        float(b.text[:1] in "©|»›·"),
    ]


@dataclass
class Costs:
    """Classifier weights (order of ``features``) and the edge weight of each tree distance, 0 to DISTANCES - 1 and beyond."""

    weights: np.ndarray
    edges: np.ndarray


#: Log-odds of a block, and edge weights, before any page is seen; fits are pulled towards these.
PRIOR = np.array([2.5, -4.0, 1.5, -6.0, -1.5, -3.0, 1.0, 0.5, 0.0, 1.0, 0.5, -0.5, -2.0])
PRIOR_EDGES = SMOOTH * np.exp(-0.7 * np.arange(DISTANCES + 1))


def training_rows(page: str, hidden: bool) -> list[tuple[int, int, int, list[float]]]:
    """(label, gap to the labelled block just before or -1, whether both have one label, features) of blocks whose containers tell their role."""
    out, before = [], None
    for b in parse_blocks(page):
        label = 0 if b.bad or b.named_bad else 1 if b.good else None
        if label is not None:
            gap = -1 if before is None else min(b.gap, DISTANCES)
            out.append((label, gap, int(before == label), features(b, hidden)))
        before = label
    return out


def fit_costs(x: np.ndarray, label: np.ndarray, gap: np.ndarray, same: np.ndarray) -> Costs:
    """Logistic fit by Newton steps towards PRIOR as the centre of a Gaussian; edges from how often neighbours agree."""
    w, hold = PRIOR.copy(), 0.5 + HOLD * len(x)
    for _ in range(30 if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (label - p) - hold * (w - PRIOR)
        h = (x * (p * (1 - p))[:, None]).T @ x + hold * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    edges = PRIOR_EDGES.copy()
    for d in range(DISTANCES + 1):
        at = gap == d
        agree, differ = same[at].sum(), (1 - same[at]).sum()
        seen = np.log((agree + 1) / (differ + 1))
        share = (agree + differ) / (agree + differ + 20)
        edges[d] = np.clip(share * seen + (1 - share) * edges[d], 0.02, SMOOTH)
    return Costs(w, edges)


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source side of a minimum cut.

    ``source[i]`` is the cost of putting i on the sink side, ``sink[i]`` of the
    source side; an edge costs its weight if its ends lie on different sides.
    Nodes with the fewest neighbours leave first; a node's best side is kept
    for every choice of its neighbours and the least cost becomes part of
    theirs.  With at most two neighbours each (edges that do not cross) this is
    linear; any graph is solved exactly, at a cost that grows with its width.
    """
    n = len(source)
    near: list[dict[int, list[float]]] = [{} for _ in range(n)]  # i -> j -> costs of (i, j) on sides 00 01 10 11
    own = [[source[i], sink[i]] for i in range(n)]
    for i, j, w in edges:
        for a, b in ((i, j), (j, i)):
            t = near[a].setdefault(b, [0.0, 0.0, 0.0, 0.0])
            t[1] += w
            t[2] += w
    queue = [i for i in range(n) if len(near[i]) <= 2]
    left, gone, order = n, [False] * n, []
    while left:
        if not queue:
            return _augmented(source, sink, edges)
        i = queue.pop()
        if gone[i] or len(near[i]) > 2:
            continue
        gone[i] = True
        left -= 1
        (c0, c1), links = own[i], list(near[i].items())
        if not links:
            order.append((i, -1, -1, (c1 < c0,)))
            continue
        a, ta = links[0]
        del near[a][i]
        if len(links) == 1:
            zero, one = (c0 + ta[0], c0 + ta[1]), (c1 + ta[2], c1 + ta[3])
            own[a][0] += min(zero[0], one[0])
            own[a][1] += min(zero[1], one[1])
            order.append((i, a, -1, (one[0] < zero[0], one[1] < zero[1])))
        else:
            b, tb = links[1]
            del near[b][i]
            best, choice = [], []
            for x in (0, 1):
                for y in (0, 1):
                    zero, one = c0 + ta[x] + tb[y], c1 + ta[2 + x] + tb[2 + y]
                    best.append(min(zero, one))
                    choice.append(one < zero)
            order.append((i, a, b, tuple(choice)))
            t = near[a].setdefault(b, [0.0, 0.0, 0.0, 0.0])
            u = near[b].setdefault(a, [0.0, 0.0, 0.0, 0.0])
            for k, v in enumerate(best):
                t[k] += v
            for k, v in enumerate((best[0], best[2], best[1], best[3])):
                u[k] += v
            if len(near[b]) <= 2:
                queue.append(b)
        if len(near[a]) <= 2:
            queue.append(a)
    side = [False] * n
    for i, a, b, choice in reversed(order):
        side[i] = choice[(2 * side[a] + side[b]) if b >= 0 else side[a] if a >= 0 else 0]
    return side


def _augmented(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The same cut by max-flow along shortest augmenting paths, for edges that cross."""
    n = len(source)
    s, t = n, n + 1
    room: list[dict[int, float]] = [{} for _ in range(n + 2)]
    for i in range(n):
        through = min(source[i], sink[i])  # flow along s-i-t at once
        room[s][i], room[i][s] = source[i] - through, 0.0
        room[i][t], room[t][i] = sink[i] - through, 0.0
    for i, j, w in edges:
        room[i][j] = room[i].get(j, 0.0) + w
        room[j][i] = room[j].get(i, 0.0) + w
    while True:
        before, queue = {s: s}, [s]
        for u in queue:
            if t in before:
                break
            for v, c in room[u].items():
                if c > 1e-9 and v not in before:
                    before[v] = u
                    queue.append(v)
        if t not in before:
            return [i in before for i in range(n)]
        path, v = [], t
        while v != s:
            path.append((before[v], v))
            v = before[v]
        flow = min(room[u][v] for u, v in path)
        for u, v in path:
            room[u][v] -= flow
            room[v][u] += flow


def block_logits(blocks: list[Block], costs: Costs) -> list[float]:
    """Log-odds of content of each block for itself."""
    return np.clip(np.array([features(b) for b in blocks]).reshape(len(blocks), len(PRIOR)) @ costs.weights, -CLIP, CLIP).tolist()


def label_blocks(blocks: list[Block], costs: Costs) -> list[bool]:
    """True for content blocks."""
    logits = block_logits(blocks, costs)
    cost = lambda z: math.log1p(math.exp(-abs(z))) + max(0.0, -z)
    edges, last_of = [], {}
    for k, b in enumerate(blocks):
        if k:
            edges.append((k - 1, k, float(costs.edges[min(b.gap, DISTANCES)])))
        if b.parent in last_of and last_of[b.parent] != k - 1:
            edges.append((last_of[b.parent], k, float(costs.edges[0])))
        last_of[b.parent] = k
    return min_cut([cost(-z) for z in logits], [cost(z) for z in logits], edges)


def main_text(page: str | None, costs: Costs) -> str:
    blocks = parse_blocks(page)
    return "\n".join(b.text for b, keep in zip(blocks, label_blocks(blocks, costs), strict=True) if keep)


def train_costs(pages: DataFrame, html_col: str = "html", max_pages: int = TRAIN_PAGES, max_blocks: int = TRAIN_BLOCKS) -> Costs:
    """Fit on at most ``max_blocks`` blocks of at most ``max_pages`` distinct whole pages, both taken in order of a hash.

    Pages are parsed by the executors; only numbers reach the driver.
    """
    sample = distinct_sample(pages.select(F.col(html_col).alias("_h")).filter("_h is not null"), "_h", max_pages).select(F.xxhash64("_h").alias("o"), "_h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for o, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = training_rows(page.as_py(), bool(o & 1))
                for at in range(0, len(rows), 4096):
                    part = rows[at : at + 4096]
                    labels, gaps, same, x = zip(*part, strict=True)
                    keys = [o] * len(part)
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(range(at, at + len(part)), pa.int32()), *[pa.array(c, pa.int32()) for c in (labels, gaps, same)], pa.array(x, pa.list_(pa.float64()))], names=["o", "k", "label", "gap", "same", "x"])

    made = sample.mapInArrow(lean(run), "o long, k int, label int, gap int, same int, x array<double>")
    got = made.orderBy(F.xxhash64("o", "k"), "o", "k").limit(max_blocks).toArrow()
    if not got.num_rows:
        return fit_costs(np.empty((0, len(PRIOR))), *[np.empty(0)] * 3)
    label, gap, same = (got.column(c).to_numpy().astype(float) for c in ("label", "gap", "same"))
    return fit_costs(np.concatenate([c.values.to_numpy() for c in got.column("x").chunks]).reshape(-1, len(PRIOR)), label, gap, same)


def extract_main_text(pages: DataFrame, costs: Costs | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per input row: page_id, url, text, n_chars.

    Null or empty html, and pages without content, give an empty text.  Blocks
    are never dropped for their length.  Null and repeated ids are rows like
    any others; ids are integers.  An empty table gives no rows; further
    columns are ignored.
    """
    ship_package(pages.sparkSession)
    costs = train_costs(pages, html_col) if costs is None else costs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(t.as_py(), costs) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")
