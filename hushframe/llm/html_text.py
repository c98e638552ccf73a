"""Main text of web pages by minimum-cut labelling.

A page becomes its blocks of text in page order. A classifier (logistic regression over FEATURES: size, punctuation, links,
element, place in the page, repeated containers, what the elements and names above say) gives every block a cost of
being content and one of being boilerplate. The costs are the capacities from the source and to the sink; neighbours in the page
and under one parent get smoothness edges, the stronger the nearer they are in the tree. The minimum cut is the labelling of least
total cost: what stays on the source's side is the article. Names (class, id, role) are one feature of many; no feature decides alone.

The classifier is fitted in numpy on made-up pages (html_pages), so it depends on no input table.

Before the flow is run, blocks whose own cost outweighs all their edges are labelled, which is exact, and their
edges become their neighbours' costs; only undecided cores need augmenting paths, so long pages stay cheap.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.batches import map_chunks
from hushframe.llm.html_pages import MARKED, made_pages

# HTML elements by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title script style noscript template iframe object svg math canvas audio video map select option datalist textarea button".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
BOILERPLATE = frozenset("nav header footer aside form menu dialog fieldset".split())
ARTICLE = frozenset("article main".split())
ENDS_P = BLOCK - {"html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend"}
# Words in class, id and role that tell what a part is.
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner banners breadcrumb breadcrumbs comment comments comentarios kommentare commentaires consent contentinfo cookie cookies "
    "copyright disqus footer gdpr header login masthead menu menubar nav navbar navigation newsletter notice notices outbrain paywall popup promo promoted promotion related replies reply "
    "respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola tags toolbar widget widgets complementary alert modal".split()
)
GOOD_WORDS = frozenset("article articlebody body content entry main post story text".split())

# Elements that a form holds only if it goes round the whole page.
FRAMED = frozenset("article footer h1 main nav".split())
# Headings, and parts of an article whose ids are often made from their titles.
TITLED = frozenset("h1 h2 h3 h4 h5 h6 section".split())

# What stands in a page's last line.
RIGHTS = re.compile(r"(?i)©|\(c\)|all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos")

_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Words on a wrapper that tell of its layout, not of what it is.
_LAYOUT = re.compile(r"(?i)(?:^|(?<=[\s_-]))(?:has|with|no|without|hide|show)[_-]\S*")
_UNSEEN = re.compile(r"display\s*:\s*none")
#: Strength of smoothness between neighbours under one parent, and pages that the classifier is fitted on.
SMOOTH, FIT_PAGES = 1.5, 1000
#: Shrinkage of the classifier's weights.
RIDGE = 5.0
FEATURES = (
    "one", "length", "short", "links", "all_links", "stops", "ends", "commas", "signs", "rights", "p", "heading", "title", "item", "cell", "bare", "in_article", "outside", "in_part", "bad_name", "bad_above", "good_name", "part_inside", "named_inside",
    "repeated", "own_links", "own_length", "up_length", "own_share", "up_share", "up_links", "before_title", "place", "last", "depth", "twins",
)


@dataclass
class Block:
    """A block's text, the node that it stands in, and how many of its characters are links'."""

    text: str
    node: int
    linked: int


class Page(HTMLParser):
    """Blocks of a page and its tree of block elements; unclosed and stray tags are taken as browsers do, roughly.

    Of each node: parent, tag, names, the share of bad words in them, and whether one is good. The work is linear in the page: open elements
    are counted by name, so a stray end tag looks no further, and nothing walks up the tree for each block.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.parent, self.tag, self.name, self.bad, self.good = [-1], [""], [""], [0.0], [False]
        self.frames: set[int] = set()  # forms around parts of a page
        self.open: list[tuple[str, int, bool]] = []  # element, node (its own or the nearest above), hidden
        self.opened: Counter[str] = Counter()
        self.forms: list[int] = []
        self.hidden = 0
        self.parts: list[str] = []
        self.linked = 0
        self.feed(html)
        self.close()
        self.flush()

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(text, self.open[-1][1] if self.open else 0, min(self.linked, len(text))))
            self.parts.clear()
        self.linked = 0

    def _close(self, at: int) -> None:
        if any(self._is_block(x) for x in self.open[at:]):
            self.flush()
        for tag, _, hidden in self.open[at:]:
            self.hidden -= hidden
            self.opened[tag] -= 1
            if tag == "form":
                self.forms.pop()
        del self.open[at:]

    @staticmethod
    def _is_block(entry: tuple[str, int, bool]) -> bool:
        return entry[0] in BLOCK

    def _close_last(self, tags: tuple[str, ...], stop: frozenset[str]) -> None:
        if any(self.opened[t] for t in tags):
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at][0] in tags:
                    return self._close(at)
                if self.open[at][0] in stop:
                    return None
        return None

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
            return
        if tag == "body":
            self._close_last(("head",), frozenset())
        if tag in BLOCK:
            if tag in ENDS_P:
                self._close_last(("p",), BLOCK - {"p"})
            if tag == "li":
                self._close_last(("li",), frozenset(["ul", "ol", "menu"]))
            elif tag in ("dd", "dt"):
                self._close_last(("dd", "dt"), frozenset(["dl"]))
            elif tag in ("td", "th"):
                self._close_last(("td", "th"), frozenset(["tr", "table"]))
            elif tag == "tr":
                self._close_last(("tr",), frozenset(["table"]))
        if tag in VOID:
            return
        above = self.open[-1][1] if self.open else 0
        hidden = tag in HIDDEN or any(k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and v and _UNSEEN.search(v)) for k, v in attrs)
        if hidden or tag in BLOCK:
            self.flush()
        node = above
        if tag in BLOCK:
            node = len(self.tag)
            titled = tag in TITLED and self.opened["article"] + self.opened["main"] > 0
            names = [v for k, v in attrs if v and k in (("class", "role") if titled else ("class", "id", "role"))]
            words = [w.lower() for v in names for w in _WORD.findall(_LAYOUT.sub(" ", v))]
            self.parent.append(above)
            self.tag.append(tag)
            self.name.append(" ".join(names))
            self.bad.append(sum(w in BAD_WORDS for w in words) / len(words) if words else 0.0)
            self.good.append(any(w in GOOD_WORDS for w in words))
        if tag in FRAMED and self.forms:
            self.frames.update(self.forms)
            self.forms[:] = [-1] * len(self.forms)  # known from now on
        if tag == "form":
            self.forms.append(node)
        self.hidden += hidden
        self.opened[tag] += 1
        self.open.append((tag, node, hidden))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "br":
            self.parts.append(" ")
        if self.opened[tag]:
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at][0] == tag:
                    self._close(at)
                    return
        if tag in BLOCK:
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)
            if self.opened["a"]:
                self.linked += len(data.strip())

    def _above(self) -> list[tuple[bool, bool, float, bool, bool, int]]:
        """Of each node: in an article; in a boilerplate element (since the article began); the worst name since then; any above it; good; depth."""
        out = [(False, False, 0.0, False, False, 0)]
        for node in range(1, len(self.tag)):
            article, part, bad, outer, good, depth = out[self.parent[node]]
            tag = self.tag[node]
            if tag in ARTICLE:
                article, part, bad, outer = True, False, 0.0, outer or part or bad > 0
            elif tag in BOILERPLATE:
                part = part or not (node in self.frames or (tag == "header" and article and not self.bad[node]))
            if tag not in ("html", "body", "article", "main") and node not in self.frames:
                bad = max(bad, self.bad[node])
            out.append((article, part, bad, outer, good or tag in ARTICLE or self.good[node], depth + 1))
        return out

    def features(self) -> list[tuple[float, ...]]:
        """FEATURES of each block."""
        above, blocks = self._above(), self.blocks
        has_article = "article" in self.tag or "main" in self.tag
        held, linked = [0] * len(self.tag), [0] * len(self.tag)  # characters and links' characters in a node and all below
        for b in blocks:
            held[b.node] += len(b.text)
            linked[b.node] += b.linked
        for node in range(len(self.tag) - 1, 0, -1):
            held[self.parent[node]] += held[node]
            linked[self.parent[node]] += linked[node]
        boxes: dict[tuple[int, str, str], set[int]] = {}
        texts = Counter(b.text for b in blocks)
        for b in blocks:
            box = self.parent[b.node] if b.node else 0
            boxes.setdefault((self.parent[box] if box else 0, self.tag[box], self.name[box]), set()).add(box)
        title = next((k for k, b in enumerate(blocks) if self.tag[b.node] == "h1"), 0)
        total, seen, out = max(1, sum(len(b.text) for b in blocks)), 0, []
        for k, b in enumerate(blocks):
            text, size, tag = b.text, len(b.text), self.tag[b.node]
            article, part, bad, outer, good, depth = above[b.node]
            box = self.parent[b.node] if b.node else 0
            up = self.parent[box] if box else 0
            links = b.linked / size
            stops = text.count(". ") + text.count("? ") + text.count("! ")
            words = text.count(" ") + 1
            signs = sum(map(text.count, "*#%|$&"))
            family = len(boxes[up, self.tag[box], self.name[box]]) if self.tag[box] in ("div", "li", "article", "section", "tr") else 1
            out.append((
                1.0, min(math.log(size) / 6, 1.2), float(words < 4), links, float(links > 0.8), min(stops, 6) / 6, float(text[-1] in ".!?…\"'"), min(text.count(","), 6) / 6, min(signs / words, 1.0), float(not article and bool(RIGHTS.search(text))),
                float(tag == "p"), float(tag in ("h2", "h3", "h4", "h5", "h6")), float(tag == "h1"), float(tag in ("li", "dd", "dt")), float(tag in ("td", "th")), float(tag in ("div", "section", "body", "form", "")),
                float(article), float(has_article and not article), float(part), bad, float(outer), float(good), float(article and part), bad * article, float(min(family, 4) - 1) / 3, linked[box] / held[box], min(math.log(held[box]) / 8, 1.2), min(math.log(held[up]) / 8, 1.2), held[box] / total, held[up] / total, linked[up] / held[up],
                float(k < title), seen / total, float(k == len(blocks) - 1), min(depth, 12) / 12, float(texts[text] > 1),
            ))
            seen += size
        return out

    def edges(self) -> list[tuple[int, int, float]]:
        """Smoothness: neighbours in page order, by their distance in the tree, and neighbours under one parent whatever stands between."""
        out, last = [], {}
        for i, block in enumerate(self.blocks):
            if i:
                a, b, apart = self.blocks[i - 1].node, block.node, 0
                while a != b:  # a node's number is above its parent's; all walks together are no longer than the tree
                    apart += 1
                    if a > b:
                        a = self.parent[a]
                    else:
                        b = self.parent[b]
                out.append((i - 1, i, SMOOTH * 2 / max(2, apart) if apart <= 2 else SMOOTH / (1 + apart)))
            box = self.parent[block.node] if block.node else 0
            if last.get(box, i) < i - 1:
                out.append((last[box], i, SMOOTH / 3))
            last[box] = i
        return out


@lru_cache(maxsize=4)
def fitted(n_pages: int = FIT_PAGES, seed: int = 3) -> np.ndarray:
    """Weights of FEATURES, by Newton's method on made-up pages; each page counts alike, whatever its number of blocks."""
    rows, truth, weight = [], [], []
    for html in made_pages(seed, n_pages):
        page = Page(html)
        labels = [b.text.startswith(MARKED) for b in page.blocks]
        for block, label in zip(page.blocks, labels):
            block.text = block.text[1:] if label and len(block.text) > 1 else block.text
        rows += page.features()
        truth += labels
        weight += [20 / len(labels)] * len(labels)
    x, y, w = np.array(rows), np.array(truth, dtype=float), np.array(weight)
    beta = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta = beta + np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(beta)), x.T @ (w * (y - p)) - RIDGE * beta)
    return beta


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether it is on the source's side of a minimum cut; edges count both ways."""
    n = len(source)
    own = [a - b for a, b in zip(source, sink)]
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if side[i] is not None or abs(own[i]) < sum(near[i].values()) - 1e-12:
            continue
        side[i] = own[i] > 0
        for j, w in near[i].items():
            own[j] += w if side[i] else -w
            near[j].pop(i)
            queue.append(j)
        near[i].clear()
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        for i, reached in zip(rest, _flow([own[i] for i in rest], rest, near)):
            side[i] = reached
    return [bool(x) for x in side]


def _flow(own: list[float], nodes: list[int], near: list[dict[int, float]]) -> list[bool]:
    """Maximum flow by shortest augmenting paths in layers; True for nodes that the source still reaches."""
    number = {node: k for k, node in enumerate(nodes)}
    s, t = len(nodes), len(nodes) + 1
    left: list[dict[int, float]] = [{} for _ in range(t + 1)]
    for k, node in enumerate(nodes):
        left[k] = {number[j]: w for j, w in near[node].items()}
    for k, x in enumerate(own):
        if x > 0:
            left[s][k], left[k][s] = x, 0.0
        else:
            left[k][t], left[t][k] = -x, 0.0
    while True:
        level = {s: 0}
        queue = deque([s])
        while queue:
            x = queue.popleft()
            for y, c in left[x].items():
                if c > 1e-12 and y not in level:
                    level[y] = level[x] + 1
                    queue.append(y)
        if t not in level:
            return [k in level for k in range(len(nodes))]
        arcs = {x: iter(list(left[x])) for x in level}
        path = [s]
        while path:
            x = path[-1]
            if x == t:
                gain = min(left[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    left[a][b] -= gain
                    left[b][a] += gain
                path = [s]
                arcs[s] = iter(list(left[s]))
                continue
            step = next((y for y in arcs[x] if left[x][y] > 1e-12 and level.get(y) == level[x] + 1), None)
            if step is None:
                path.pop()
                if path:
                    level[x] = -1
            else:
                path.append(step)


def label(page: Page, gains: np.ndarray) -> list[bool]:
    """Which blocks are content; gains: by how much content is likelier for each, as logits."""
    gains = np.clip(gains, -8, 8)
    return minimum_cut(np.maximum(gains, 0).tolist(), np.maximum(-gains, 0).tolist(), page.edges())


def main_texts(pages: list[str | None], weights: np.ndarray) -> list[str]:
    """The article's blocks of each page, joined by line feeds; empty for null, empty and content-free pages."""
    parsed = [Page(html or "") for html in pages]
    rows = [row for page in parsed for row in page.features()]
    gains = np.array(rows).reshape(-1, len(FEATURES)) @ weights
    out, at = [], 0
    for page in parsed:
        n = len(page.blocks)
        out.append("\n".join(b.text for b, keep in zip(page.blocks, label(page, gains[at : at + n])) if keep) if n else "")
        at += n
    return out


def main_text(html: str | None) -> str:
    """main_texts of one page."""
    return main_texts([html], fitted())[0]


def extract(pages: DataFrame) -> DataFrame:
    """For each row of pages (page_id, url, html): page_id, url, text, n_chars.

    A null page is an empty one; page_id and url may be null. Pages of any length are taken whole, and nothing of an article
    is cut. Repeated rows repeat; an empty table gives no rows. Other columns are ignored.
    """
    sent = pages.sparkSession.sparkContext.broadcast(fitted())

    def make():
        weights = sent.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = main_texts(batch.column("html").to_pylist(), weights)
            return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

        return work

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_chunks(rows, "html", make, "page_id long, url string, text string", 1 << 20).withColumn("n_chars", F.char_length("text").cast("long"))
