"""Operator 10: main-text extraction by gradient-boosted trees over DOM nodes.

A page's block elements are the nodes. Their features are the element's tag,
tokens of its class, id and role, the same of its ancestors, depth, siblings,
text and link density of the subtree, and place in the page. Boosted trees give
each node the chance that it belongs to the main text. Decoding is hierarchical:
from the leaves up, a subtree is kept whole, dropped whole, or left to its
children, whichever is likeliest in all, so no node is kept inside a dropped one
or dropped inside a kept one. There are no labelled pages among the tables, so
the trees are fitted to seeded pages of many layouts (see page_layouts); fitting
takes no corpus data and each page is extracted where it lies.

Text is joined by block: character references are decoded, white space becomes
one space (a line break counts as white space), blocks are joined by line feeds.
Scripts, styles, form controls and other elements without running text never
yield any.

Defined results: null or empty html gives an empty text; markup of any kind is
read leniently; repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinsight.llm.dom import Node, parse
from kinsight.llm.page_layouts import Layouts

# Tags and attribute tokens that features tell apart.
TAGS = ("p", "div", "section", "article", "main", "nav", "header", "footer", "aside", "ul", "ol", "li", "form", "table", "blockquote", "ins", "body")
TOKENS = {
    "navigation": "nav menu navigation navbar breadcrumb breadcrumbs pagination pager crumbs",
    "header": "header masthead banner logo top tagline",
    "footer": "footer copyright bottom colophon legal contentinfo",
    "side": "sidebar side aside widget rail related recommended more complementary stories",
    "advert": "ad ads advert advertisement adsbygoogle sponsor sponsored promo promotion commercial",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay message toast warning",
    "comment": "comment comments commentlist discussion disqus reply replies respond response responses feedback",
    "form": "form search login signup subscribe newsletter register",
    "share": "share social sharing follow",
    "content": "content article post entry main story body text",
}
GROUPS = {word: k for k, words in enumerate(TOKENS.values()) for word in words.split()}
TAG_AT = {t: k for k, t in enumerate(TAGS)}
N_TAGS, N_GROUPS = len(TAGS), len(TOKENS)
#: tag, heading, ancestors' tags, own token groups, ancestors' token groups, then numbers
#: Pages scored together.
GROUP = 100
WIDTH = 2 * N_TAGS + 1 + 2 * N_GROUPS + 12


def described(root: Node) -> tuple[list[Node], np.ndarray]:
    """The block nodes in page order and a row of features for each."""
    nodes: list[Node] = []
    rows: list[np.ndarray] = []
    sums: list[list[float]] = []
    page = [0]

    def walk(node: Node, above: np.ndarray, index: int, count: int) -> list[float]:
        row = np.zeros(WIDTH)
        tag = TAG_AT.get(node.tag)
        if tag is not None:
            row[tag] = 1
        row[N_TAGS] = len(node.tag) == 2 and node.tag[0] == "h"
        base = 2 * N_TAGS + 1
        row[N_TAGS + 1 : base] = above[:N_TAGS]
        row[base + N_GROUPS : base + 2 * N_GROUPS] = above[N_TAGS:]
        below = above.copy()
        if tag is not None:
            below[tag] = 1
        for token in node.tokens:
            group = GROUPS.get(token)
            if group is not None:
                row[base + group] = 1
                below[N_TAGS + group] = 1
        nodes.append(node)
        rows.append(row)
        before = page[0]
        # characters, characters of links, elements, paragraphs, list items, sentence ends
        total = [0.0, 0.0, 1.0, float(node.tag == "p"), float(node.tag == "li"), 0.0]
        children = node.children()
        k = 0
        for item in node.items:
            if isinstance(item, Node):
                part = walk(item, below, k, len(children))
                k += 1
                for i, x in enumerate(part):
                    total[i] += x
            else:
                text, linked = (item, False) if isinstance(item, str) else item
                n = len(text.strip())
                total[0] += n
                total[1] += n * linked
                total[5] += text.count(".") + text.count("!") + text.count("?")
                page[0] += n
        row[base + 2 * N_GROUPS :] = (node.depth, index, count, index / max(count - 1, 1), len(children), np.log1p(total[0]), total[1] / max(total[0], 1), total[0] / total[2], total[3], total[4], total[5] / max(total[0], 1) * 100, before)
        sums.append(total)
        return total

    for k, child in enumerate(root.children()):
        walk(child, np.zeros(N_TAGS + N_GROUPS), k, len(root.children()))
    x = np.array(rows) if rows else np.zeros((0, WIDTH))
    x[:, -1] /= max(page[0], 1)
    return nodes, x


@dataclass
class Tree:
    """A complete tree of fixed depth: feature and threshold of inner nodes, values of leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(int(np.log2(len(self.value)))):
            at = 2 * at + 1 + (x[np.arange(len(x)), self.feature[at]] > self.threshold[at])
        return at - len(self.feature)


@dataclass
class BoostedTrees:
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    def chance(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if not len(x):
            return total
        for tree in self.trees:
            total += tree.value[tree.leaf(x)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow(x: np.ndarray, edges: list[np.ndarray], bins: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float, ridge: float) -> Tree:
    inner = 2**depth - 1
    feature, threshold, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
    held = {0: np.arange(len(x))}
    for at in range(inner):
        rows = held.pop(at)
        best = (1e-6, 0, np.inf)
        if len(rows) > 1:
            gs, hs = g[rows].sum(), h[rows].sum()
            for j, cuts in enumerate(edges):
                if not len(cuts):
                    continue
                left_g, left_h = (np.cumsum(np.bincount(bins[rows, j], v[rows], len(cuts) + 1))[:-1] for v in (g, h))
                gain = left_g**2 / (left_h + ridge) + (gs - left_g) ** 2 / (hs - left_h + ridge) - gs**2 / (hs + ridge)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, float(cuts[k]))
        feature[at], threshold[at] = best[1], best[2]
        right = x[rows, best[1]] > best[2]
        held[2 * at + 1], held[2 * at + 2] = rows[~right], rows[right]
    for leaf in range(inner + 1):
        rows = held[inner + leaf]
        value[leaf] = rate * g[rows].sum() / (h[rows].sum() + ridge)
    return Tree(feature, threshold, value)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, ridge: float = 1.0, max_bins: int = 24) -> BoostedTrees:
    share = y.mean()
    model = BoostedTrees(float(np.log(share / (1 - share))))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, max_bins + 1)[:-1])) for j in range(x.shape[1])]
    edges = [e[e < x[:, j].max()] for j, e in enumerate(edges)]
    bins = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    total = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        tree = grow(x, edges, bins, y - p, p * (1 - p), depth, rate, ridge)
        model.trees.append(tree)
        total += tree.value[tree.leaf(x)]
    return model


def labelled(nodes: list[Node]) -> np.ndarray:
    """1 or 0 for nodes whose whole text is or isn't main text, -1 for mixed ones."""
    marks = {}
    for node in nodes:
        marks[id(node)] = node.mark or (marks.get(id(node.parent)) if node.parent else None)
    kinds: dict[int, set] = {}
    for node in reversed(nodes):
        own = kinds.setdefault(id(node), set())
        if not node.children() or any(not isinstance(i, Node) and (i if isinstance(i, str) else i[0]).strip() for i in node.items):
            own.add(marks[id(node)])
        if node.parent is not None:
            kinds.setdefault(id(node.parent), set()).update(own)
    return np.array([int(next(iter(k))) if len(k := kinds[id(n)]) == 1 and None not in k else -1 for n in nodes])


@lru_cache(maxsize=1)
def trained(pages: int = 900, seed: int = 11) -> BoostedTrees:
    layouts, xs, ys = Layouts(seed), [], []
    for _ in range(pages):
        nodes, x = described(parse(layouts.page()))
        y = labelled(nodes)
        xs.append(x[y >= 0])
        ys.append(y[y >= 0])
    return fit(np.concatenate(xs), np.concatenate(ys).astype(float))


def decode(nodes: list[Node], chance: np.ndarray) -> set[int]:
    """Ids of the nodes that are kept. A subtree is kept, dropped or split, whichever is likeliest."""
    p = np.clip(chance, 1e-4, 1 - 1e-4)
    keep, drop = dict(zip(map(id, nodes), np.log(p))), dict(zip(map(id, nodes), np.log1p(-p)))
    best: dict[int, tuple[float, str]] = {}
    own = dict(zip(map(id, nodes), p))
    for node in reversed(nodes):
        children, me = node.children(), id(node)
        for c in children:
            keep[me] += keep[id(c)]
            drop[me] += drop[id(c)]
        options = [(keep[me], "keep"), (drop[me], "drop")]
        if children:
            # a split node is neither; its chance says nothing
            options.append((sum(best[id(c)][0] for c in children) + np.log(0.5), "split"))
        best[me] = max(options)
    kept: set[int] = set()

    def settle(node: Node, choice: str) -> None:
        if choice == "keep" or (choice == "split" and own[id(node)] >= 0.5):
            kept.add(id(node))
        for c in node.children():
            settle(c, best[id(c)][1] if choice == "split" else choice)

    inside = {id(n) for n in nodes}
    for node in nodes:
        if node.parent is None or id(node.parent) not in inside:
            settle(node, best[id(node)][1])
    return kept


def blocks(root: Node, kept: set[int]) -> list[str]:
    """Texts of the kept nodes' blocks, in page order."""
    out: list[str] = []
    held: list[str] = []

    def close() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append(text)

    def walk(node: Node) -> None:
        close()
        for item in node.items:
            if isinstance(item, Node):
                walk(item)
                close()
            elif id(node) in kept:
                held.append(item if isinstance(item, str) else item[0])
        close()

    walk(root)
    return out


def extract_many(pages: list[str | None], model: BoostedTrees) -> list[str]:
    """Main texts; the trees score the nodes of all pages at once."""
    roots = [parse(h or "") for h in pages]
    found = [described(r) for r in roots]
    chances = model.chance(np.concatenate([x for _, x in found])) if found else np.zeros(0)
    out, at = [], 0
    for root, (nodes, x) in zip(roots, found):
        kept = decode(nodes, chances[at : at + len(x)]) if nodes else {id(root)}
        at += len(x)
        out.append("\n".join(blocks(root, kept)))
    return out


def extract(html: str | None, model: BoostedTrees) -> str:
    return extract_many([html], model)[0]


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: BoostedTrees | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    model = model or trained()
    source = pages.select(id_col, url_col, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sys

        sys.setrecursionlimit(20_000)
        for batch in (whole.slice(at, GROUP) for whole in batches for at in range(0, whole.num_rows, GROUP)):
            texts = extract_many(batch.column(2).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
