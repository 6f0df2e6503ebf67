"""Main text of web pages: a graphical model on the tree of their elements.

Every block element is a node that is content or not. Its own looks (tag, names, text,
links) speak for or against it, and a potential between parent and child lets neighbours
speak for each other. Sum-product messages go up the tree and down again, which gives each
node its exact marginal; the text of nodes that are rather content is the page's text.
Potentials of edges are smoothed frequencies of child labels by parent label, weights of
looks are fitted by the same messages (observed minus expected features), both on labelled
pages. A page can label itself: what its ``article`` or ``main`` element holds, apart from
elements that by their name never are content, is content.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import prepare, written

# Elements whose text is never shown as text, or belongs to a control.
DROPPED = {
    "script", "style", "head", "title", "noscript", "template", "iframe", "select", "option", "textarea", "button", "canvas", "audio", "video", "datalist",
}
# Their content is not markup; it ends at the end tag.
RAW = {"script", "style", "title", "textarea", "iframe", "noscript"}
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
    "track", "wbr",
}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em",
    "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "rt", "s", "samp", "small", "span",
    "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
    # Formulas, drawings and embedded things stand in a sentence, and so does their text.
    "math", "semantics", "annotation", "mrow", "mi", "mn", "mo", "ms", "mtext", "mfrac", "msqrt", "mroot",
    "msub", "msup", "msubsup", "munder", "mover", "munderover", "mfenced", "mstyle", "mpadded",
    "svg", "g", "text", "tspan", "path", "object",
}
# An opening tag of the key ends an open element of the values, up to the fence.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
FENCES = {"ul", "ol", "dl", "table", "article", "section", "div", "body", "blockquote", "nav", "main"}

TAG = re.compile(r"(/?)([A-Za-z][A-Za-z0-9:_-]*)")
# Inside a tag: up to its end, or to a value in quotes.
UNQUOTED = re.compile(r"""[^>=]*(?:=(?!\s*["'])[^>=]*)*""")
QUOTE = re.compile(r"""=\s*(["'])""")
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
WORDS = re.compile(r"[a-z]+")

# What the names of elements say before anything is learned: log odds of being content.
NOT_CONTENT = {
    "nav", "menu", "navbar", "header", "footer", "sidebar", "aside", "widget", "ad", "ads", "advert",
    "advertisement", "banner", "promo", "sponsor", "sponsored", "notice", "cookie", "consent", "alert",
    "form", "comment", "comments", "reply", "replies", "disqus", "related", "recommended", "share",
    "social", "breadcrumb", "breadcrumbs", "subscribe", "newsletter", "login", "pagination",
    "toolbar", "popup", "modal", "copyright", "masthead", "complementary", "navigation",
    "contentinfo", "dialog",
}
CONTENT = {"article", "main", "content", "post", "entry", "story", "prose"}
SAYS = 5.0
# Elements whose names describe the whole page rather than a part of it.
WHOLE = {"html", "body", "#page"}
ROOT = "#page"


@dataclass
class Page:
    """Nodes in page order, parents first, and the runs of text between block borders."""

    parent: list[int] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    names: list[frozenset[str]] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    marks: list[int] = field(default_factory=list)
    children: list[int] = field(default_factory=list)
    runs: list[tuple[int, str]] = field(default_factory=list)


def pieces(html: str) -> Iterator[tuple[str, str, str]]:
    """The text and the tags of a page in order: ("", "", text), ("<" or "</", name in lower
    case, attributes).

    A value in quotes may hold what would end its tag; a quote that nothing closes is an
    ordinary character. A tag or comment that the page breaks off in is no text. Elements
    that are dropped are passed over whole. Every place is looked at a bounded number of
    times, whatever the page breaks off or leaves open.
    """
    at, end = 0, len(html)
    last = {quote: html.rfind(quote) for quote in "\"'"}
    endless: set[str] = set()  # dropped elements that nothing closes any more
    while at < end:
        start = html.find("<", at)
        if start < 0:
            yield "", "", html[at:]
            return
        if start > at:
            yield "", "", html[at:start]
        at = start + 1
        if html.startswith("!--", at):
            stop = html.find("-->", at + 1)
            at = end if stop < 0 else stop + 3
            continue
        if html.startswith(("!", "?"), at):
            stop = html.find(">", at)
            at = end if stop < 0 else stop + 1
            continue
        found = TAG.match(html, at)
        if found is None:
            yield "", "", "<"
            continue
        at = inside = found.end()
        while True:
            at = UNQUOTED.match(html, at).end()
            if at >= end:
                return
            if html[at] == ">":
                break
            opening = QUOTE.match(html, at)
            at = opening.end()
            if last[opening[1]] >= at:
                at = html.index(opening[1], at) + 1
        tag, attributes = found[2].lower(), html[inside:at]
        at += 1
        if tag not in DROPPED:
            yield "</" if found[1] else "<", tag, attributes
        elif not found[1] and not attributes.endswith("/"):
            stop = None if tag in endless else re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            if stop:
                at = stop.end()
            else:
                endless.add(tag)
                if tag in RAW:
                    return


def parse(html: str) -> Page:
    """A forgiving tree of the block elements.

    Inline elements belong to their block. Missing end tags are supplied where the next
    block, item or end tag shows that they are missing; stray ones are ignored.
    """
    page = Page()
    stack: list[tuple[str, int]] = []  # open blocks
    open_tags: Counter[str] = Counter()
    depth_in_link = 0
    parts: list[str] = []

    def opened(tag: str, attributes: str) -> None:
        names: set[str] = set()
        if attributes:
            for value in NAMED.findall(attributes):
                names.update(WORDS.findall(value.lower()))
        above = stack[-1][1] if stack else -1
        if above >= 0:
            page.children[above] += 1
        stack.append((tag, len(page.tags)))
        open_tags[tag] += above >= 0
        page.parent.append(above)
        page.tags.append(tag)
        page.names.append(frozenset(names))
        page.chars.append(0)
        page.links.append(0)
        page.marks.append(0)
        page.children.append(0)

    def closed() -> str:
        tag, _ = stack.pop()
        open_tags[tag] -= 1
        return tag

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                node = stack[-1][1]
                page.runs.append((node, text))
                page.chars[node] += len(text)
                page.marks[node] += text.count(",") + text.count(".")

    def add(raw: str) -> None:
        text = entities.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if depth_in_link:
            page.links[stack[-1][1]] += len(text)

    opened(ROOT, "")
    for kind, tag, text in pieces(html):
        if not kind:
            add(text)
        elif tag in VOID:
            if tag in ("br", "hr"):
                parts.append(" ")
        elif tag in INLINE:
            if tag == "a":
                depth_in_link = depth_in_link + 1 if kind == "<" else max(0, depth_in_link - 1)
        elif kind == "</":
            if open_tags[tag]:
                flush()
                while closed() != tag:
                    pass
                depth_in_link = 0
        else:
            flush()
            depth_in_link = 0
            if stack[-1][0] == "p":
                closed()
            ends = CLOSES.get(tag, ())
            if any(open_tags[name] for name in ends):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ends:
                        while len(stack) > k:
                            closed()
                        break
                    if stack[k][0] in FENCES:
                        break
            opened(tag, text)
    flush()
    return page


def _step(value: float, steps: tuple[float, ...]) -> int:
    return sum(value >= s for s in steps)


def never_content(page: Page, node: int) -> bool:
    """By its tag or names; an element that names itself content, too, is not meant."""
    tag, names = page.tags[node], page.names[node]
    if tag in WHOLE or tag in CONTENT:
        return False
    return tag in NOT_CONTENT or (bool(names & NOT_CONTENT) and not names & CONTENT)


def looks(page: Page, node: int) -> tuple[list[str], list[str]]:
    """Features of a node that name it, and those that only measure it."""
    chars = page.chars[node]
    named = [f"tag={page.tags[node]}", f"never={never_content(page, node)}"]
    if page.tags[node] not in WHOLE:
        named += [f"name={n}" for n in page.names[node] if len(n) < 30 and n not in NOT_CONTENT]
    measured = [f"chars={_step(chars, (1, 20, 60, 150, 400))}", f"leaf={page.children[node] == 0}"]
    if chars:
        measured.append(f"links={_step(page.links[node] / chars, (0.05, 0.3, 0.8))}")
        measured.append(f"marks={_step(100 * page.marks[node] / chars, (0.3, 1.0, 2.5))}")
    return named, measured


def labels_of(page: Page) -> list[int] | None:
    """1 for nodes inside article or main, but for elements that are never content; None
    for a page without either."""
    labels, found = [], False
    for node, above in enumerate(page.parent):
        tag = page.tags[node]
        inherited = labels[above] if above >= 0 else 0
        if tag in ("article", "main"):
            found, inherited = True, 1
        elif never_content(page, node):
            inherited = 0
        labels.append(inherited)
    return labels if found else None


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Forest:
    """The trees of some pages as arrays, by depth."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.tags) for p in pages], dtype=np.int64)
        self.start = np.concatenate(([0], np.cumsum(sizes)))
        parent, depth, kind = [], [], []  # kind of the edge above a node
        for page, base in zip(pages, self.start.tolist()):
            depths: list[int] = []
            for above in page.parent:
                depths.append(0 if above < 0 else depths[above] + 1)
                parent.append(above + base if above >= 0 else -1)
            depth += depths
            never = [never_content(page, node) for node in range(len(page.tags))]
            kind += [(n == 0) + 2 * (up >= 0 and never[up]) for n, up in zip(page.children, page.parent)]
        self.parent = np.array(parent, dtype=np.int64)
        self.kind = np.array(kind, dtype=np.int64)
        depth = np.array(depth, dtype=np.int64)
        order = np.argsort(depth, kind="stable")
        self.by_depth = np.split(order, np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []

    def marginals(self, node: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """P(content) of each node.

        ``node`` has log potentials (n, 2), ``edge`` (kind, parent, child). Messages go up
        from the deepest level, then down; both are exact on a tree.
        """
        below, up = node.copy(), np.zeros_like(node)
        for level in reversed(self.by_depth[1:]):
            up[level] = _lse(below[level][:, None, :] + edge[self.kind[level]], 2)
            np.add.at(below, self.parent[level], up[level])
        full = below.copy()
        for level in self.by_depth[1:]:
            rest = full[self.parent[level]] - up[level]
            joint = rest[:, :, None] + edge[self.kind[level]]
            full[level] = below[level] + _lse(joint, 1)
        top = full - _lse(full, 1)[:, None]
        return np.exp(top[:, 1])


# Before anything is seen: P(child is content) by kind of edge (to an inner node or a leaf,
# then the same below an element that never is content) and by the parent's label. What is
# seen counts for EDGE_SEEN of the whole, so that no pair of labels is ruled out.
EDGE_PRIOR = ((0.2, 0.6), (0.2, 0.8), (0.005, 0.3), (0.005, 0.3))
EDGE_SEEN = 0.7


def _potentials(rates: np.ndarray) -> tuple:
    both = np.log(np.stack([1 - rates, rates], axis=2))
    return tuple(tuple(tuple(round(float(x), 4) for x in line) for line in kind) for kind in both)


@dataclass(frozen=True)
class Model:
    """Weights of node features; log potentials of edges by kind, parent and child."""

    weights: dict[str, float] = field(default_factory=dict)
    edges: tuple = _potentials(np.array(EDGE_PRIOR))

    def content(self, pages: list[Page]) -> list[np.ndarray]:
        """P(content) of the nodes of each page."""
        forest = Forest(pages)
        get = self.weights.get
        said = np.zeros((int(forest.start[-1]), 2))
        said[:, 1] = [
            sum(get(name, 0.0) for group in looks(page, node) for name in group)
            for page in pages
            for node in range(len(page.tags))
        ]
        found = forest.marginals(said, np.array(self.edges))
        return np.split(found, forest.start[1:-1])


def prior_weights() -> dict[str, float]:
    says = {f"{kind}={name}": SAYS for name in CONTENT for kind in ("tag", "name")}
    return says | {"never=True": -SAYS, "never=False": 0.0}


def fit_edges(forest: Forest, truth: np.ndarray) -> tuple:
    below = forest.parent >= 0
    seen = np.zeros((len(EDGE_PRIOR), 2, 2))
    of_parent, of_child = truth[forest.parent[below]].astype(int), truth[below].astype(int)
    np.add.at(seen, (forest.kind[below], of_parent, of_child), 1.0)
    counts, prior = seen.sum(axis=2), np.array(EDGE_PRIOR)
    trust = EDGE_SEEN * counts / (counts + 10)
    rates = seen[:, :, 1] / np.maximum(counts, 1)
    return _potentials(trust * rates + (1 - trust) * prior)


def fit(pages: list[Page], labels: list[list[int]], steps: int = 200, pull: float = 2.0) -> Model:
    """Weights from labelled pages, pulled towards what names say and otherwise to zero.

    On every fourth page the features that name a node are hidden, so that the others
    learn to do without them.
    """
    prior = prior_weights()
    if not pages:
        return Model(prior)
    forest = Forest(pages)
    vocabulary: dict[str, int] = {name: k for k, name in enumerate(prior)}
    rows, columns = [], []
    for k, page in enumerate(pages):
        base = int(forest.start[k])
        for node in range(len(page.tags)):
            named, measured = looks(page, node)
            for name in measured + (named if k % 4 else []):
                rows.append(base + node)
                columns.append(vocabulary.setdefault(name, len(vocabulary)))
    row, column = np.array(rows), np.array(columns)
    centre = np.zeros(len(vocabulary))
    centre[: len(prior)] = list(prior.values())
    truth = np.concatenate([np.array(l, dtype=float) for l in labels])
    edges = fit_edges(forest, truth)
    edge, weights = np.array(edges), centre.copy()
    first, second = np.zeros(len(weights)), np.zeros(len(weights))
    for step in range(1, steps + 1):
        said = np.zeros((len(truth), 2))
        said[:, 1] = np.bincount(row, weights=weights[column], minlength=len(truth))
        found = forest.marginals(said, edge)
        slope = np.bincount(column, weights=(truth - found)[row], minlength=len(weights))
        slope = (slope - pull * (weights - centre)) / len(truth)
        first += 0.1 * (slope - first)
        second += 0.01 * (slope * slope - second)
        weights += 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model({name: round(float(weights[k]), 4) for name, k in vocabulary.items()}, edges)


def learn(pages: DataFrame, rows: int = 300, html_col: str = "html", id_col: str = "page_id") -> Model:
    """Fits the model on pages that label themselves; see ``labels_of``.

    The sample is at most ``rows`` pages, those whose id has the smallest hash, of at most
    ``SAMPLE_CHARS`` characters each so that its size is bounded. Null pages do not count;
    without any labelled page the weights are what the names say.
    """
    usable = pages.select(
        pages[id_col].cast("string").alias("page_id"), pages[html_col].cast("string").alias("html")
    ).where(F.col("html").isNotNull() & (F.length("html") <= SAMPLE_CHARS))
    # Ids alone are compared over all tasks; then the chosen pages are fetched.
    drawn = usable.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(rows)
    chosen = written(drawn.withColumnRenamed("page_id", "drawn"), "html-sample")
    sample = (
        usable.join(F.broadcast(chosen), F.col("page_id").eqNullSafe(F.col("drawn")))
        .groupBy("page_id")
        .agg(F.min("html").alias("html"))  # of pages that repeat an id, one
        .orderBy("page_id")
        .collect()
    )
    parsed = [parse(row.html) for row in sample]
    labels = [labels_of(page) for page in parsed]
    usable = [(p, l) for p, l in zip(parsed, labels) if l is not None]
    return fit([p for p, _ in usable], [l for _, l in usable])


SAMPLE_CHARS = 20_000
# Pages whose trees are solved together.
TOGETHER = 100


def main_text(pages: list[str], model: Model, least: float = 0.5) -> list[str]:
    """The content of each page, blocks joined by one blank."""
    parsed = [parse(html) for html in pages]
    return [
        " ".join(text for node, text in page.runs if content[node] >= least)
        for page, content in zip(parsed, model.content(parsed))
    ]


def extract(
    pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    The whole html is read. Null and empty pages have empty text. Rows are independent:
    repeated and null ids and urls are kept as they are; other columns are ignored.
    """
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            htmls, texts = batch.column(2).to_pylist(), []
            for start in range(0, len(htmls), TOGETHER):
                texts += main_text(htmls[start : start + TOGETHER], model)
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string())]
            columns.append(pa.array([len(text) for text in texts], pa.int64()))
            yield pa.record_batch(columns, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(
        pages[id_col].cast("long").alias("page_id"),
        pages[url_col].cast("string").alias("url"),
        F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"),
    )
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
