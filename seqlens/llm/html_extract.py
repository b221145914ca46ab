"""Main-text extraction by minimum-cut labelling (operator 10).

A page is cut into blocks of text at block-level tags. A logistic classifier over a block's containers, links,
length and the tags and class words next to it gives each block a cost of being called content and one of being called boilerplate:
its capacities to the two terminals. Blocks that follow one another, and blocks that share a parent, are tied by edges that fade with
their distance in the DOM. The minimum cut is the labelling of least total cost; its source side is the text.

The classifier is fitted on pages that mark their article, with that mark hidden: a maximum a posteriori fit around what HTML's own tags
and customary class words mean, so that signs which no page of the sample shows keep their meaning. The strength of edges is fitted
likewise. Most blocks cost more to mislabel than all their edges weigh; they are settled before the flow (the optimum keeps
them), and the flow runs over those that are left: blocks without telling tags or classes, which follow their neighbours.

Parsing takes time in proportion to a page's length, whatever it holds: elements that are open are kept by name.
"""

from __future__ import annotations

import html
import json
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlens.llm.common import map_batches

#: Fixed values of HTML: elements without content, blocks, and elements whose content is never text of the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noframes ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
HIDDEN = frozenset("script style noscript template head title select option button textarea input svg math canvas object iframe audio video".split())
CLOSES_P = BLOCK - {"body", "html", "option", "optgroup", "tbody", "td", "tfoot", "th", "thead", "tr", "title", "frameset", "legend", "noframes"}
#: A tag of this name ends an open one of these names.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": set(), "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = frozenset("ul ol dl table nav article section div aside body html form footer header main menu".split())

#: What tags and customary words of class, id and role mean, in log-odds of content.
TAG_WEIGHT = {"article": 3.0, "main": 2.0, "nav": -6.0, "footer": -6.0, "header": -4.0, "aside": -6.0, "form": -6.0, "menu": -6.0, "dialog": -6.0, "search": -6.0, "fieldset": -4.0, "address": -1.5}
WORD_WEIGHT = {
    "ad ads advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promoted promotion banner adsense dfp": -7.0,
    "comment comments commentlist respond reply replies disqus discussion reaction reactions": -7.0,
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager topbar toolbar": -6.0,
    "sidebar aside widget widgets related recommended recommendations recommend trending popular": -6.0,
    "footer foot copyright colophon legal": -6.0,
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login": -6.0,
    "share sharing social follow masthead tags": -5.0,
    "article content post entry story main text body": 1.0,
}
WORDS = {w: x for group, x in WORD_WEIGHT.items() for w in group.split()}
ROLES = {"navigation": -6.0, "banner": -5.0, "contentinfo": -6.0, "complementary": -6.0, "search": -6.0, "form": -6.0, "dialog": -6.0, "alert": -6.0, "menu": -6.0, "article": 1.0, "main": 1.0}
#: Words that only say which part of a page or list an element is, as do single letters.
PARTS = frozenset("area bar block blog body bottom box btn button center col column container content group header holder id inner item items left link links list main middle module outer page panel part primary right row secondary section site slot top unit wrap wrapper zone".split())
#: Elements that are lines of text; of the rest, inside an article, classes are those of containers.
LINES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th caption figcaption b i em strong span mark small code".split())
#: Words of parts of a page that texts are about, too.
TOPICS = frozenset("social popular legal trending follow reaction reactions discussion menu navigation sharing story text".split())
#: What is left of a sign that a name's other words, or its place on a line of an article, make doubtful.
TOPIC_SHARE = 0.25
#: Features of a block, and the classifier's weights before the fit: a constant; the worst and the best sign among its containers; being
#: outside any article or main element of a page that has one; the share of its text in links; its length in logs.
FEATURES = ("one", "worst", "best", "outside", "links", "length")
PRIOR = (1.8, 1.0, 1.0, -3.0, -4.0, 0.3)
#: How firmly the fit holds to these: to the constant most, as the share of content in marked pages is not that in others. And the most
#: words and tags beside blocks that get weights of their own.
FIRMNESS = (1e6, 4.0, 4.0, 4.0, 4.0, 4.0)
TOKEN_FIRMNESS = 4.0
MAX_TOKENS = 200
#: Pages that the classifier is fitted on, and blocks of one of them, at most.
FIT_PAGES, FIT_BLOCKS = 400, 250
#: Rows of the fit that are spread out to a matrix at a time.
FIT_ROWS = 4096
MOST = 12.0
#: Edges between blocks in a row, and between those two apart, each less with the steps between them in the DOM. The first is fitted
#: within its bounds.
NEXT, SECOND, FADE = 1.0, 0.4, 0.6
NEXT_LEAST, NEXT_MOST = 0.5, 1.5

_token = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z|(?=[\"']))|([^<]++|<)", re.S)
#: The same where quotes are no longer heeded, as one of them is never closed.
_plain_token = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|([^<]++|<)", re.S)
#: An attribute's name, and its value in double quotes, single quotes or none.
_attribute = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>\"']+)))?")
_no_display = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_word = re.compile(r"[a-z]+")
_case = re.compile(r"([a-z])([A-Z])")


@dataclass(slots=True, eq=False)
class Node:
    tag: str
    parent: Node | None
    depth: int = 0
    #: The worst and the best sign on the way from the root; the best without those of article and main.
    worst: float = 0.0
    best: float = 0.0
    plain_best: float = 0.0
    hidden: bool = False
    link: bool = False
    article: bool = False
    words: tuple[str, ...] = ()


@dataclass(slots=True)
class Block:
    text: str
    node: Node
    link_share: float


@dataclass
class Model:
    """Weights of FEATURES and of the tokens beside a block (in log-odds of content), and the strength of edges."""

    weights: tuple[float, ...] = PRIOR
    tokens: dict[str, float] = field(default_factory=dict)
    next: float = NEXT


def attributes_of(text: str) -> dict[str, str]:
    """Attributes by lower-case name, the first of each; character references in values are decoded."""
    found: dict[str, str] = {}
    for name, *values in _attribute.findall(text):
        found.setdefault(name.lower(), html.unescape("".join(values)))
    return found


def is_hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or bool(_no_display.search(attributes.get("style", "")))


def name_sign(name: str, line: bool) -> tuple[float, list[str]]:
    """What one class or id says, and its words. line: of an element that is a line of text and no container.

    A line whose name has a word that belongs to no part of a page ("menu-recipe", "banner-history") or one that is a topic too ("social") may be named after what it tells."""
    words = _word.findall(_case.sub(r"\1 \2", name).lower())
    weights = [WORDS.get(w, 0.0) for w in words]
    least = min(weights, default=0.0)
    if least >= 0:
        return max(weights, default=0.0), words
    topic = line and any(w in TOPICS or w not in WORDS and w not in PARTS and len(w) > 3 for w in words)
    return least * (TOPIC_SHARE if topic else 1.0), words


def signs(attributes: dict[str, str], line: bool) -> tuple[float, tuple[str, ...]]:
    """The strongest sign in class, id and role; and the words there. Names that speak for content weaken one that speaks against it on a line."""
    words: list[str] = []
    weights = [ROLES.get(attributes["role"].strip().lower(), 0.0)] if "role" in attributes else []
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        weight, own = name_sign(name, line)
        weights.append(weight)
        words += own
    least, most = min(weights, default=0.0), max(weights, default=0.0)
    return (least + (most if line and most > 0 else 0.0) if least < 0 else max(most, 0.0)), tuple(dict.fromkeys(words))


class Parser:
    """The blocks of visible text of a page, in page order."""

    def __init__(self, page: str):
        self.page = page
        self.top = self.node = Node("", None)
        #: Open elements by name, and those that stop a search for one, innermost last.
        self.open: dict[str, list[Node]] = {}
        self.scopes: list[Node] = []
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = self.size = 0
        self.start = self.top

    def end_block(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                self.blocks.append(Block(text, self.start, self.linked / max(self.size, 1)))
            self.parts = []
        self.linked = self.size = 0

    def add(self, text: str) -> None:
        if not self.node.hidden:
            if not self.parts:
                self.start = self.node
            self.parts.append(text)
            self.size += len(text)
            self.linked += len(text) if self.node.link else 0

    def nearest(self, tags: set[str], scoped: bool) -> Node | None:
        """The innermost open element of these names; scoped: none if an element that stops the search lies between."""
        found = max((own[-1] for t in tags if (own := self.open.get(t))), key=lambda n: n.depth, default=None)
        return None if found is not None and scoped and self.scopes and self.scopes[-1].depth > found.depth else found

    def close(self, element: Node) -> bool:
        """Out of an open element; whether a block ended with it."""
        block = False
        while True:
            node = self.node
            self.open[node.tag].pop()
            if node.tag in SCOPE:
                self.scopes.pop()
            block = block or node.tag in BLOCK
            self.node = node.parent
            if node is element:
                return block

    def end_tag(self, tag: str) -> None:
        element = self.nearest({tag}, scoped=tag in BLOCK and tag not in SCOPE)
        if element is not None:
            at = self.node
            while at is not element and at.tag not in BLOCK:
                at = at.parent
            if at.tag in BLOCK:
                self.end_block()
            self.close(element)

    def start_tag(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self.end_block()
        elif tag == "br":
            if not self.node.hidden and self.parts:
                self.parts.append("\n")
            return
        for names in ({"p"} if tag in CLOSES_P else None, ENDS.get(tag)):
            if names and (element := self.nearest(names, scoped=True)) is not None:
                self.close(element)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK and tag not in RAW:
            return
        up = self.node
        named = attributes_of(attributes) if attributes else {}
        own, words = signs(named, up.article and tag in LINES) if named else (0.0, ())
        of_tag = TAG_WEIGHT.get(tag, 0.0)
        if tag == "header" and up.article:
            own = of_tag = 0.0  # an article's own header
        sign = min(own, of_tag) if min(own, of_tag) < 0 else max(own, of_tag)
        article = tag in ("article", "main")
        hidden = up.hidden or tag in HIDDEN or is_hidden(named)
        node = Node(tag, up, up.depth + 1, min(up.worst, sign), max(up.best, sign), max(up.plain_best, own if article else sign), hidden, up.link or tag == "a", up.article or article, words)
        self.node = node
        self.open.setdefault(tag, []).append(node)
        if tag in SCOPE:
            self.scopes.append(node)

    def run(self) -> list[Block]:
        page, at, n, token = self.page, 0, len(self.page), _token
        while at < n:
            m = token.match(page, at)
            at = m.end()
            closing, name, attributes, text = m.groups()
            if text is not None:
                self.add(text)
                continue
            if name is None:
                continue
            if token is _token and at < n and page[at - 1] != ">":  # a quote that is never closed: the tag ends at the next >
                token = _plain_token
                at = page.find(">", at) + 1 or n
            tag = name.lower()
            if closing:
                self.end_tag(tag)
                continue
            self.start_tag(tag, attributes)
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}[^>]*(?:>|\Z)", re.I).search(page, at)
                body = page[at : close.start() if close else n]
                at = close.end() if close else n
                if tag == "xmp":
                    self.add(html.escape(body))
                self.end_tag(tag)
        self.end_block()
        return self.blocks


def blocks_of(page: str) -> list[Block]:
    return Parser(page).run()


def features(block: Block, has_article: bool, hide: bool = False) -> tuple[list[float], list[str]]:
    """FEATURES of a block, and the tokens beside it: tags and class words of its element and that one's parent. has_article: whether
    its page has an article or main element with text. hide: as if no element were one."""
    node = block.node
    worst, best = node.worst, node.plain_best if hide else node.best
    in_article = node.article and not hide
    # Links and length tell little once a container has; in an article a short line is a line.
    links = block.link_share if worst > -3.0 and (not in_article or block.link_share > 0.9 and best < 2.0) else 0.0
    length = math.log1p(len(block.text)) - math.log1p(60) if worst > -3.0 and best < 2.0 else 0.0
    outside = float(has_article and not node.article and not hide)
    up = node.parent or node
    skip = ("article", "main", "body", "html", "")
    tokens = [f"{place}.{word}" for place, x in (("own", node), ("up", up)) for word in (x.tag, *x.words) if word not in skip]
    return [1.0, worst, best if worst > -3.0 else 0.0, outside, links, length], tokens


def log_odds(block: Block, has_article: bool = False, model: Model | None = None) -> float:
    """Of being content."""
    model = model or Model()
    values, tokens = features(block, has_article)
    x = sum(w * v for w, v in zip(model.weights, values, strict=True)) + sum(model.tokens.get(t, 0.0) for t in tokens)
    return max(-MOST, min(MOST, x))


def fit_model(rows: list[tuple[list[float], list[str], bool]], pairs: tuple[int, int]) -> Model:
    """The maximum a posteriori fit to blocks (features, tokens, whether content), and to the numbers of siblings in a row that are alike and
    that are not. Without blocks of both kinds the model before the fit."""
    y = np.array([label for _, _, label in rows], float)
    if not 0 < y.sum() < len(y):
        return Model()
    count: dict[str, int] = {}
    for _, tokens, _ in rows:
        for t in set(tokens):
            count[t] = count.get(t, 0) + 1
    known = sorted(count, key=lambda t: (-count[t], t))[:MAX_TOKENS]
    place = {t: len(FEATURES) + i for i, t in enumerate(known)}
    values = np.array([v for v, _, _ in rows], float)
    places = [[place[t] for t in tokens if t in place] for _, tokens, _ in rows]

    def matrices() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(rows), FIT_ROWS):
            own = places[at : at + FIT_ROWS]
            x = np.zeros((len(own), len(FEATURES) + len(known)))
            x[:, : len(FEATURES)] = values[at : at + FIT_ROWS]
            x[np.repeat(np.arange(len(own)), [len(p) for p in own]), np.array([t for p in own for t in p], int)] = 1.0
            yield x, y[at : at + FIT_ROWS]

    prior = np.concatenate([PRIOR, np.zeros(len(known))])
    firm = np.concatenate([FIRMNESS, np.full(len(known), TOKEN_FIRMNESS)])
    w = prior.copy()
    for _ in range(30):  # Newton's method; the prior keeps the Hessian definite
        bend, slope = np.diag(firm), firm * (w - prior)
        for x, label in matrices():
            p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
            bend = bend + (x * (p * (1 - p))[:, None]).T @ x
            slope = slope + x.T @ (p - label)
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    w = np.round(w, 9)
    alike, other = pairs
    strength = float(np.clip(0.25 * math.log((alike + 4.0) / (other + 1.0)), NEXT_LEAST, NEXT_MOST))
    return Model(tuple(w[: len(FEATURES)].tolist()), dict(zip(known, w[len(FEATURES) :].tolist(), strict=True)), strength)


def examples(page: str, most: int = FIT_BLOCKS) -> tuple[list[tuple[list[float], list[str], bool]], tuple[int, int]]:
    """What a page with an article teaches: its blocks, with the article hidden; at most `most`, evenly spread. And the numbers of siblings
    in a row, alike and not."""
    blocks = blocks_of(page)
    if not any(b.node.article for b in blocks):
        return [], (0, 0)
    labels = [b.node.article and b.node.worst > -3.0 for b in blocks]
    step = -(-len(blocks) // most)
    siblings = [a == b for x, y, a, b in zip(blocks, blocks[1:], labels, labels[1:], strict=False) if x.node.parent is y.node.parent]
    rows = [(*features(b, True, hide=True), label) for b, label in zip(blocks, labels, strict=True)]
    return rows[::step], (sum(siblings), len(siblings) - sum(siblings))


def fit(pages: DataFrame, html_col: str = "html", fit_pages: int = FIT_PAGES) -> Model:
    """A model fitted on at most fit_pages distinct pages, those of the least hashes. Pages without an article or main element teach nothing."""
    h = F.xxhash64(pages[html_col])
    chosen = [r["h"] for r in pages.where(pages[html_col].isNotNull()).select(h.alias("h")).distinct().orderBy("h").limit(fit_pages).collect()]
    if not chosen:
        return Model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [json.dumps(examples(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["h", "found"])

    sample = pages.select(h.alias("h"), pages[html_col].cast("string").alias("html")).where(F.col("h").isin(chosen)).dropDuplicates(["h"])
    rows: list = []
    alike = other = 0
    for r in map_batches(sample, run, "h long, found string").orderBy("h").collect():
        own, (a, o) = json.loads(r["found"])
        rows += own
        alike, other = alike + a, other + o
    return fit_model(rows, (alike, other))


def steps(a: Node, b: Node) -> int:
    """Edges of the DOM between two elements."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source's side of the minimum cut. odds: positive ones are capacities from the
    source, negative ones to the sink."""
    n = len(odds)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    label: list[bool | None] = [None] * n
    odds = list(odds)
    settled = deque(range(n))
    while settled:  # a node that outweighs its free edges is on its side in every minimum cut
        i = settled.popleft()
        if label[i] is None and abs(odds[i]) > sum(w for j, w in near[i] if label[j] is None):
            label[i] = odds[i] > 0
            for j, w in near[i]:
                if label[j] is None:
                    odds[j] += w if label[i] else -w
                    settled.append(j)
    free = [i for i in range(n) if label[i] is None]
    if not free:
        return [bool(x) for x in label]
    capacity: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if label[a] is None and label[b] is None:
            capacity[a][b] = capacity[a].get(b, 0.0) + w
            capacity[b][a] = capacity[b].get(a, 0.0) + w
    source = {i: odds[i] for i in free if odds[i] > 0}
    sink = {i: -odds[i] for i in free if odds[i] < 0}
    closed: set[int] = set()  # nodes from which no sink can be reached any more: the source's side
    for root in source:
        while root not in closed and source[root] > 1e-12:  # shortest augmenting paths from this source
            before: dict[int, int] = {root: -1}
            queue = deque(before)
            end = -1
            while queue:
                i = queue.popleft()
                if sink.get(i, 0.0) > 1e-12:
                    end = i
                    break
                for j, c in capacity[i].items():
                    if c > 1e-12 and j not in before and j not in closed:
                        before[j] = i
                        queue.append(j)
            if end < 0:
                closed.update(before)
                break
            path = [end]
            while before[path[-1]] >= 0:
                path.append(before[path[-1]])
            flow = min([source[root], sink[end], *(capacity[b][a] for a, b in zip(path, path[1:], strict=False))])
            source[root] -= flow
            sink[end] -= flow
            for a, b in zip(path, path[1:], strict=False):
                capacity[b][a] -= flow
                capacity[a][b] += flow
    return [bool(x) if x is not None else i in closed for i, x in enumerate(label)]


def labels_of(blocks: list[Block], model: Model | None = None) -> tuple[list[bool], int]:
    """Whether each block is content, and of how many the cut changed what the classifier alone says."""
    model = model or Model()
    edges = []
    for apart, weight in ((1, model.next), (2, SECOND)):
        for i in range(len(blocks) - apart):
            a, b = blocks[i].node, blocks[i + apart].node
            if apart == 1 or a.parent is b.parent:
                edges.append((i, i + apart, weight * FADE ** max(0, steps(a, b) - 2)))
    has_article = any(b.node.article for b in blocks)
    odds = [log_odds(b, has_article, model) for b in blocks]
    content = minimum_cut(odds, edges)
    return content, sum(c != (x > 0) for c, x in zip(content, odds, strict=True))


def main_text(page: str | None, model: Model | None = None) -> str:
    """Content blocks, one a line."""
    return extracted(page, model)[0]


def extracted(page: str | None, model: Model | None = None) -> tuple[str, int, int]:
    """The text, the number of blocks and of those that the cut changed."""
    blocks = blocks_of(page) if page else []
    content, changed = labels_of(blocks, model)
    return "\n".join(b.text for b, is_content in zip(blocks, content, strict=True) if is_content), len(blocks), changed


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_changed (by the cut) of every row, in one pass without a shuffle; with the model before the fit
    unless one is given.

    A null or empty page has the empty text. One row out for each row in, null and repeated ids included; pages are read whole, in time
    that grows with their length; on a tie of costs a block is boilerplate. Other columns are not read."""
    source = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extracted(h, model) for h in batch.column(2).to_pylist()]
            cols = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["page_id", "url", "text", "n_blocks", "n_changed"])

    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    found = map_batches(source, run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_blocks long, n_changed long")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_changed")
