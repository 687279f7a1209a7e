"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element and every run of text is a node that is content or not. A node's own potential is a logistic function of
its features, a parent and child share a potential, and sum-product messages up and down the tree give each node's
exact marginal; text nodes that are content more likely than not make up the result.

The potentials are learned from labelled pages: a bounded sample of the table's pages whose author marked the article
by its element, and built pages that show each kind of boilerplate beside and inside an article.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser
from math import exp, log1p

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulcast.llm.words import blocks

MOST_PAGES = 400  # about as many labelled pages are sampled
LONGEST = 200_000  # characters that a sampled page stays below
BUILT_TIMES = 3  # how often each built page counts
BUCKETS = 256  # hashed tags and class words
DENSE = 6
EPOCHS = 1500
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd mark q s samp small span strong sub sup time u var".split())
HIDDEN = frozenset("script style template noscript".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("article aside body div footer header main nav ol section table td ul".split())
FRAME = frozenset(("#root", "html", "body"))
BOILER_TAGS = "nav header footer aside form button select label".split()
BOILER_CLASSES = "ad ads advert sidebar comments comment menu cookie notice banner promo share related newsletter breadcrumb popup widget social".split()
_WORD = re.compile(r"[a-z]+")


@dataclass
class Tree:
    """Nodes in page order, so that a parent stands before its children."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)  # "" for text
    words: list[str] = field(default_factory=list)  # class and id
    text: list[str] = field(default_factory=list)
    block: list[int] = field(default_factory=list)  # which block a text node belongs to

    def add(self, parent: int, tag: str, words: str, text: str, block: int) -> int:
        for values, value in zip((self.parent, self.tag, self.words, self.text, self.block), (parent, tag, words, text, block)):
            values.append(value)
        return len(self.tag) - 1


class Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tree, self.open, self.block, self.hidden = Tree(), [], 0, 0
        self.open.append(self.tree.add(-1, "#root", "", "", 0))

    def _close(self, at: int) -> None:
        for node in self.open[at:]:
            self.hidden -= self.tree.tag[node] in HIDDEN
            self.block += self.tree.tag[node] not in INLINE
        del self.open[at:]

    def _close_open(self, tags: tuple[str, ...], stop: frozenset[str]) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            tag = self.tree.tag[self.open[at]]
            if tag in tags:
                return self._close(at)
            if tag in stop:
                return None

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close_open(("p",), SCOPE)
        elif tag in SAME:
            self._close_open(SAME[tag], frozenset(("ul", "ol", "dl", "table", "select")))
        if tag in VOID:
            if tag in ("br", "hr"):
                self.handle_data(" ")
            return
        known = dict(attrs)
        words = f"{known.get('class') or ''} {known.get('id') or ''} {known.get('role') or ''}".lower()
        self.block += tag not in INLINE
        self.hidden += tag in HIDDEN
        self.open.append(self.tree.add(self.open[-1], tag, words, "", 0))

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, 0, -1):
            if self.tree.tag[self.open[at]] == tag:
                return self._close(at)

    def handle_data(self, data):
        if not self.hidden and data:
            self.tree.add(self.open[-1], "", "", data, self.block)


def parse(html: str | None) -> Tree:
    builder = Builder()
    builder.feed(html or "")
    builder.close()
    return builder.tree


@lru_cache(maxsize=1 << 16)
def _names(tag: str, words: str) -> tuple[int, ...]:
    """Buckets of a tag and of the distinct words of its class and id."""
    return (xxhash.xxh32_intdigest(f"t {tag}") % BUCKETS, *(xxhash.xxh32_intdigest(f"c {w}") % BUCKETS for w in dict.fromkeys(_WORD.findall(words))))


def features(tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Dense features of each node's subtree, and hashed names as index lists (padded with the last, zero column)."""
    n = len(tree.tag)
    parent, inside_link = tree.parent, [False] * n
    for i in range(1, n):
        inside_link[i] = tree.tag[i] == "a" or inside_link[parent[i]]
    total = [len(t.strip()) for t in tree.text]
    linked = [size if inside else 0 for size, inside in zip(total, inside_link)]
    marks = [sum(map(t.count, ".,;:!?")) if t else 0 for t in tree.text]
    for i in range(n - 1, 0, -1):
        up = parent[i]
        total[up] += total[i]
        linked[up] += linked[i]
        marks[up] += marks[i]
    total, linked, marks = (np.array(x, np.float64) for x in (total, linked, marks))
    is_text = np.array([t == "" for t in tree.tag], np.float64)
    size = np.log1p(total) / 5
    dense = np.stack([size * is_text, size * (1 - is_text), linked / (total + 1), marks / (total + 1) * 10, is_text, np.ones(n)], axis=1)
    names = list(map(_names, tree.tag, tree.words))
    width = max(map(len, names))
    return dense, np.array([found + (BUCKETS,) * (width - len(found)) for found in names], np.int64)


def labels_of(tree: Tree) -> np.ndarray:
    """1 below an article or main element unless boilerplate stands between; 0 elsewhere."""
    out = np.zeros(len(tree.tag), np.int64)
    for i in range(1, len(out)):
        tag = tree.tag[i]
        if tag in BOILER_TAGS or tag in HIDDEN or set(_WORD.findall(tree.words[i])) & set(BOILER_CLASSES):
            out[i] = 0
        else:
            out[i] = tag in ("article", "main") or out[tree.parent[i]]
    return out


def relation(tree: Tree, i: int) -> int:
    """What a node is to its parent: 1 a text, 2 an element right below the page's frame, 0 any other element."""
    return 1 if tree.tag[i] == "" else 2 if tree.tag[tree.parent[i]] in FRAME else 0


def built_pages() -> list[str]:
    """Labelled pages with each kind of boilerplate before, inside and after an article.

    Its words are those of the article, so that a paragraph's place decides and not its wording.
    """
    kinds = [(f"<{t}>", f"</{t}>") for t in BOILER_TAGS] + [(f'<{e} class="{c}">', f"</{e}>") for c in BOILER_CLASSES for e in ("div", "section")]
    body = "<h1>Some title</h1><p>Several words make up this sentence, and here they end.</p><ul><li>One item.</li></ul><p>More <b>words</b> follow.</p>"
    line = "<p>Several words make up this sentence, and here they end.</p><ul><li><a href=x>One item.</a></li></ul>"
    return [
        f"<html><head><title>Some title</title></head><body>{a}{line}{z}<{m}>{body}{a}{line}{z}</{m}>{a}{line}{z}</body></html>"
        for a, z in kinds
        for m in ("article", "main")
    ]


@dataclass
class Potentials:
    dense: np.ndarray
    names: np.ndarray
    pair: np.ndarray  # logarithm, [relation, parent's label, child's label]


def train(pages: list[str]) -> Potentials:
    """Own potentials by logistic regression, shared ones as log ratios of joint to independent frequencies."""
    trees = [parse(p) for p in pages]
    found = [features(t) for t in trees]
    width = max(i.shape[1] for _, i in found)
    x = np.vstack([d for d, _ in found])
    index = np.vstack([np.pad(i, ((0, 0), (0, width - i.shape[1])), constant_values=BUCKETS) for _, i in found])
    y = np.concatenate([labels_of(t) for t in trees])
    joint = np.ones((3, 2, 2))
    for tree in trees:
        label = labels_of(tree)
        up = np.array(tree.parent[1:], np.int64)
        kind = np.array([relation(tree, i) for i in range(1, len(tree.tag))], np.int64)
        np.add.at(joint, (kind, label[up], label[1:]), 1)
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    pair = np.log(joint / (joint.sum(axis=2, keepdims=True) * joint.sum(axis=1, keepdims=True)))
    dense, names = np.zeros(DENSE), np.zeros(BUCKETS + 1)
    power_d, power_n = np.full(DENSE, 1e-8), np.full(BUCKETS + 1, 1e-8)
    for _ in range(EPOCHS):
        z = x @ dense + names[index].sum(axis=1)
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g_dense = x.T @ error + 1e-7 * dense
        g_names = np.bincount(index.ravel(), np.repeat(error, width), BUCKETS + 1) + 1e-7 * names
        power_d, power_n = power_d + g_dense**2, power_n + g_names**2
        dense -= 0.3 * g_dense / np.sqrt(power_d)
        names -= 0.3 * g_names / np.sqrt(power_n)
        names[BUCKETS] = 0
    return Potentials(dense, names, pair)


def in_forms(tree: Tree) -> np.ndarray:
    """Whether a node belongs to a form, but for forms that wrap at least half of the page's text."""
    if "form" not in tree.tag:
        return np.zeros(len(tree.tag), bool)
    size = [len(t.strip()) for t in tree.text]
    for i in range(len(size) - 1, 0, -1):
        size[tree.parent[i]] += size[i]
    inside = np.zeros(len(size), bool)
    for i in range(1, len(size)):
        inside[i] = inside[tree.parent[i]] or (tree.tag[i] == "form" and 2 * size[i] < size[0])
    return inside


def _log_sum(a: float, b: float) -> float:
    """Logarithm of the sum of two numbers given by their logarithms."""
    return a + log1p(exp(b - a)) if a > b else b + log1p(exp(a - b))


def marginals(tree: Tree, p: Potentials) -> np.ndarray:
    """Each node's probability of content: messages from the leaves up, then from the root down.

    Forms are known not to be content, so their nodes have next to no potential of it.
    """
    dense, index = features(tree)
    z = np.clip(dense @ p.dense + p.names[index].sum(axis=1), -12, 12)
    z[in_forms(tree)] = -60
    n, parent, pair = len(z), tree.parent, p.pair.tolist()
    kind = [0, *(relation(tree, i) for i in range(1, n))]
    up_0, up_1 = [0.0] * n, z.tolist()  # own potential and all messages from below, for either label
    message_0, message_1 = [0.0] * n, [0.0] * n
    for i in range(n - 1, 0, -1):
        (p_00, p_01), (p_10, p_11) = pair[kind[i]]
        to_0, to_1 = _log_sum(p_00 + up_0[i], p_01 + up_1[i]), _log_sum(p_10 + up_0[i], p_11 + up_1[i])
        most = max(to_0, to_1)
        message_0[i], message_1[i] = to_0 - most, to_1 - most
        up_0[parent[i]] += message_0[i]
        up_1[parent[i]] += message_1[i]
    for i in range(1, n):  # from here on up is the belief of a node whose parent's is known
        (p_00, p_01), (p_10, p_11) = pair[kind[i]]
        rest_0, rest_1 = up_0[parent[i]] - message_0[i], up_1[parent[i]] - message_1[i]
        to_0, to_1 = _log_sum(p_00 + rest_0, p_10 + rest_1), _log_sum(p_01 + rest_0, p_11 + rest_1)
        most = max(to_0, to_1)
        up_0[i] += to_0 - most
        up_1[i] += to_1 - most
    return 1 / (1 + np.exp(np.array(up_0) - np.array(up_1)))


def main_text(html: str | None, p: Potentials) -> str:
    tree = parse(html)
    content = marginals(tree, p)
    found: dict[int, list[str]] = {}
    for i, tag in enumerate(tree.tag):
        if tag == "" and content[i] > 0.5:
            found.setdefault(tree.block[i], []).append(tree.text[i])
    return " ".join(t for t in (re.sub(r"\s+", " ", "".join(x)).strip() for x in found.values()) if t)


def labelled_pages(pages: DataFrame, most: int = MOST_PAGES, longest: int = LONGEST) -> list[str]:
    """The built pages, and about ``most`` pages of the table that mark their article and have fewer than ``longest``
    characters: those whose hash falls below a share of its range, so no task sends more than its own."""
    marked = pages.where(F.lower("html").contains("<article") & (F.length("html") < longest))
    marked = marked.select("html", F.xxhash64("html").alias("key"))
    n = marked.agg(F.approx_count_distinct("key", 0.01)).first()[0]
    below = F.col("key") <= F.lit(-(2**63) + (2**64 - 1) * min(most, n) // max(n, 1))
    return built_pages() * BUILT_TIMES + sorted(r["html"] for r in marked.where(below).dropDuplicates(["key"]).collect())


def extract(pages: DataFrame, p: Potentials) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages(page_id, url, html)``.

    A null or empty html gives an empty text. Markup that never closes is closed at the end of its container. Repeated
    rows give repeated results, nulls in the ids are carried, other columns are not read, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "html"):
                texts = [main_text(h, p) for h in batch.column("html").to_pylist()]
                columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return given.mapInArrow(run, "page_id long, url string, text string, n_chars long")
