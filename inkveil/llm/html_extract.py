"""Main text of pages by a tree-structured graphical model over the DOM.

Every element and text block is a variable, content or not. Unary potentials come from what a node shows of itself
(tag, class and id words, length, links, punctuation); pairwise potentials tie each node to its parent, by the child's
kind. Sum-product messages pass from the leaves to the root and back, which on a tree gives the exact marginals; a text
block is content if its marginal is over a half. The weights maximise the likelihood of labelled pages, whose gradient
needs the same marginals. The labelled pages are ``TRAIN_PAGES`` invented ones (:mod:`inkveil.llm.html_pages`).

Messages run over many pages at once, one tree depth at a time, so a batch costs a few array operations a level.

Defined results. Null or empty html, or none of its blocks content: empty text. Repeated rows: each by itself. Markup
that is cut short, unclosed or wrongly nested is parsed as far as it goes. White space includes the no-break space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.html_pages import labelled
from inkveil.llm.html_tree import Node, parse

TRAIN_PAGES, ROUNDS, RATE, DECAY = 400, 250, 0.3, 1e-3
#: Characters of html in a batch of trees.
BATCH_CHARS = 2 << 20

_TAGS = [
    "nav header footer aside form menu", "article main", "section", "div", "p", "h1", "h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "table tr td th tbody thead tfoot", "blockquote pre figure figcaption", "button input label fieldset", "#text", "#root",
]
_TAG = {t: k for k, ts in enumerate(_TAGS) for t in ts.split()}
_WORDS = [
    "ad ads advert advertisement advertising adsense banner promo promoted promotion sponsor sponsored sponsors commercial dfp outbrain taboola",
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc topbar toolbar skip",
    "header masthead head footer foot copyright legal bottom colophon",
    "sidebar side aside widget related recommended recommendations more popular trending rail teaser",
    "cookie cookies consent notice alert popup modal overlay gdpr dialog warning message disclaimer",
    "comment comments reply replies respond disqus discussion reader responses feedback thread",
    "form search login signin signup subscribe subscription newsletter register",
    "share sharing social tags tag meta byline author follow",
    "content article post entry story body main text page prose",
    "hidden none",
]
_WORD = {w: k for k, ws in enumerate(_WORDS) for w in ws.split()}
_N = len(_TAGS) + len(_WORDS)
N_FEATURES = _N + 7
#: Kinds of edges, by the child: a named part, a structural element, a text block or a small block.
_EDGES = 4
_SPLIT = re.compile(r"[^a-z0-9]+")


@cache
def _named(names: str) -> tuple[int, ...]:
    return tuple(sorted({_WORD[w] for w in _SPLIT.split(names) if w in _WORD}))


class Forest:
    """Trees as arrays: ``parent`` (-1 for roots), ``depth``, ``edge``, features as sparse ``(node, feature, value)``."""

    def __init__(self, pages: list[list[Node]]):
        parent, depth, edge, rows, cols, vals = [], [], [], [], [], []
        leaf: list[int] = []
        for nodes in pages:
            base = len(parent)
            for k, node in enumerate(nodes):
                i = base + k
                up = -1 if node.parent < 0 else base + node.parent
                parent.append(up)
                depth.append(0 if up < 0 else depth[up] + 1)
                tag = _TAG.get(node.tag)
                named = _named(node.names) if node.names else ()
                edge.append(2 if node.tag == "#text" else 0 if named or tag == 0 else 1 if tag in (1, 2, 3, None) else 3)
                if tag is not None:
                    rows.append(i), cols.append(tag), vals.append(1.0)
                for w in named:
                    rows.append(i), cols.append(len(_TAGS) + w), vals.append(1.0)
                rows.append(i), cols.append(_N), vals.append(1.0)
                if node.tag == "#text":
                    leaf.append(i)
                    text = node.text
                    for f, x in (
                        (1, min(len(text), 400) / 200), (2, node.linked / len(text)), (3, float(len(text) < 25)),
                        (4, float(text[-1] in ".!?…:;\"”»")), (5, float("©" in text or "|" in text)), (6, min(text.count(",") + text.count("."), 6) / 6),
                    ):
                        if x:
                            rows.append(i), cols.append(_N + f), vals.append(x)
        self.parent, self.depth, self.edge = np.array(parent), np.array(depth), np.array(edge)
        self.rows, self.cols, self.vals = np.array(rows), np.array(cols), np.array(vals)
        self.leaf = np.array(leaf, dtype=np.int64)
        order = np.argsort(self.depth, kind="stable")
        cuts = np.searchsorted(self.depth[order], np.arange(self.depth.max() + 2 if len(order) else 1))
        self.levels = [order[a:b] for a, b in zip(cuts, cuts[1:])]

    def marginals(self, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Exact marginals by sum-product. ``unary``: a weight a feature, for content; ``pair``: kinds x 2 x 2 (parent, child).

        Returns P(content) of each node, P(parent, child) of each node's edge (2 x 2), and the log partition function
        summed over the trees.
        """
        n = len(self.parent)
        phi = np.zeros((n, 2))
        phi[:, 1] = np.bincount(self.rows, self.vals * unary[self.cols], minlength=n)
        up, message = phi.copy(), np.zeros((n, 2))
        for at in reversed(self.levels[1:]):  # leaves to root
            m = np.logaddexp(pair[self.edge[at], :, 0] + up[at, :1], pair[self.edge[at], :, 1] + up[at, 1:])
            message[at] = m
            np.add.at(up, self.parent[at], m)
        down = np.zeros((n, 2))
        joint = np.zeros((n, 2, 2))
        roots = self.levels[0]
        z = np.logaddexp(up[roots, 0], up[roots, 1])
        log_z = np.zeros(n)
        log_z[roots] = z
        for at in self.levels[1:]:  # root to leaves
            p = self.parent[at]
            log_z[at] = log_z[p]
            outside = down[p] + up[p] - message[at]
            scores = outside[:, :, None] + pair[self.edge[at]] + up[at][:, None, :]
            joint[at] = np.exp(scores - log_z[at][:, None, None])
            down[at] = np.logaddexp(outside[:, 0, None] + pair[self.edge[at], 0], outside[:, 1, None] + pair[self.edge[at], 1])
        belief = up + down
        return np.exp(belief[:, 1] - np.logaddexp(belief[:, 0], belief[:, 1])), joint, z.sum()


def _truth(nodes: list[Node], blocks: list[tuple[str, bool]]) -> np.ndarray:
    """Labels of all nodes: a block's own; an element is content if more of the text below it is than isn't."""
    weight = np.zeros(len(nodes))
    todo = list(blocks)
    for k, node in enumerate(nodes):
        if node.tag == "#text":
            label = next((c for t, c in todo if t == node.text), False)
            weight[k] = len(node.text) * (1 if label else -1)
    leaf = weight.copy()
    for k in range(len(nodes) - 1, 0, -1):
        weight[nodes[k].parent] += weight[k]
    return np.array([(leaf[k] if n.tag == "#text" else weight[k]) > 0 for k, n in enumerate(nodes)])


@cache
def trained(pages: int = TRAIN_PAGES, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The weights, by gradient ascent with adaptive steps on the likelihood of labelled pages."""
    sample = labelled(pages, seed)
    trees = [parse(html) for html, _ in sample]
    y = np.concatenate([_truth(t, b) for t, (_, b) in zip(trees, sample)]).astype(int)
    forest = Forest(trees)
    child = np.flatnonzero(forest.parent >= 0)
    seen_u = np.bincount(forest.cols, forest.vals * y[forest.rows], minlength=N_FEATURES)
    seen_p = np.zeros((_EDGES, 2, 2))
    np.add.at(seen_p, (forest.edge[child], y[forest.parent[child]], y[child]), 1)
    unary, pair = np.zeros(N_FEATURES), np.zeros((_EDGES, 2, 2))
    su, sp = np.full(N_FEATURES, 1e-8), np.full(pair.shape, 1e-8)
    for _ in range(ROUNDS):
        p, joint, _ = forest.marginals(unary, pair)
        gu = (seen_u - np.bincount(forest.cols, forest.vals * p[forest.rows], minlength=N_FEATURES)) / pages - DECAY * unary
        expected = np.zeros_like(pair)
        np.add.at(expected, forest.edge[child], joint[child])
        gp = (seen_p - expected) / pages - DECAY * pair
        su, sp = 0.9 * su + 0.1 * gu**2, 0.9 * sp + 0.1 * gp**2
        unary, pair = unary + RATE * gu / np.sqrt(su + 1e-4), pair + RATE * gp / np.sqrt(sp + 1e-4)
    return unary, pair


def blocks(htmls: list[str], weights: tuple[np.ndarray, np.ndarray]) -> list[list[tuple[str, float]]]:
    """For each page its text blocks in order, each with its probability of being content."""
    trees = [parse(h) for h in htmls]
    forest = Forest(trees)
    p = forest.marginals(*weights)[0]
    out, base = [], 0
    for nodes in trees:
        out.append([(n.text, float(p[base + k])) for k, n in enumerate(nodes) if n.tag == "#text"])
        base += len(nodes)
    return out


def texts(htmls: list[str], weights: tuple[np.ndarray, np.ndarray]) -> list[str]:
    return ["\n".join(t for t, p in page if p > 0.5) for page in blocks(htmls, weights)]


def _run(weights: tuple[np.ndarray, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = [h or "" for h in batch.column(2).to_pylist()]
            out, part, size = [], [], 0
            for h in html:
                part.append(h)
                size += len(h)
                if size > BATCH_CHARS:
                    out += texts(part, weights)
                    part, size = [], 0
            if part:
                out += texts(part, weights)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return run


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)``, a row a page. The weights, some hundred numbers, go along with the tasks."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_run(trained()), "page_id bigint, url string, text string, n_chars bigint")
