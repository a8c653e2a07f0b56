"""Main text of web pages by a tree-structured graphical model over their nodes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracesieve.llm.batches import text_batches
from tracesieve.llm.pages import BUCKETS, EDGES, Page, labelled_pages, parse

#: Labelled pages that the model is trained on: the bound of the fit.
TRAINING = 800
#: Nodes whose marginals are found at a time.
NODES = 200_000


@dataclass
class Forest:
    """The nodes of some pages in a row: parents, features and edge types, and the order in which messages go.

    ``order`` puts the nodes of one depth side by side, those of one parent too; ``starts`` are the places where a depth begins and
    ``families`` those where a parent's children do.
    """

    parent: np.ndarray
    cuts: np.ndarray
    at: np.ndarray
    edge: np.ndarray
    order: np.ndarray
    starts: np.ndarray
    families: np.ndarray

    @staticmethod
    def of(pages: list[Page]) -> "Forest":
        sizes = np.array([len(p.parent) for p in pages])
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        parent = np.fromiter((x for p in pages for x in p.parent), np.int64, sizes.sum())
        depth = np.fromiter((x for p in pages for x in p.depth), np.int64, sizes.sum())
        counts = np.fromiter((b - a for p in pages for a, b in zip(p.cuts, p.cuts[1:])), np.int64, sizes.sum())
        at = np.fromiter((x for p in pages for x in p.at), np.int64, counts.sum())
        edge = np.fromiter((x for p in pages for x in p.edge), np.int64, sizes.sum())
        parent = np.where(parent < 0, -1, parent + first)
        order = np.lexsort((parent, depth))
        starts = np.flatnonzero(np.diff(depth[order], prepend=-1))
        families = np.flatnonzero(np.diff(parent[order], prepend=-2))
        return Forest(parent, np.concatenate(([0], np.cumsum(counts))), at, edge, order, starts, families)


@dataclass
class TreeModel:
    """Potentials in logs: a weight of content for each feature, and for each edge type a table of parent and child states."""

    weights: np.ndarray
    edges: np.ndarray

    def marginals(self, f: Forest, edges: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """By sum-product: each node's probability of content, and (if asked for) the joint one of parent and child for each edge.

        Upward, a node tells its parent for each state of it how well all below fits; downward, it tells each child how well all
        the rest fits.  Nodes of one depth send their messages together, and a depth costs what its nodes do, however many depths
        there are.
        """
        n = len(f.parent)
        ends = np.concatenate(([0.0], np.cumsum(self.weights[f.at])))
        below = np.zeros((n, 2))
        below[:, 1] = (ends[f.cuts[1:]] - ends[f.cuts[:-1]])[f.order]
        place = np.empty(n, np.int64)
        place[f.order] = np.arange(n)
        over = place[f.parent[f.order]]  # where each node's parent stands in this order; of a root, unused
        table, up, rest = self.edges[f.edge[f.order]], np.zeros((n, 2)), np.zeros((n, 2))
        # Sums of a parent's children: one call for a depth, and none of them looks at another depth's nodes.
        levels = list(zip(f.starts.tolist(), [*f.starts[1:].tolist(), n], np.searchsorted(f.families, f.starts).tolist(), [*np.searchsorted(f.families, f.starts[1:]).tolist(), len(f.families)]))
        for a, b, first, last in levels[:0:-1]:
            t = table[a:b] + below[a:b, None, :]
            up[a:b] = np.logaddexp(t[:, :, 0], t[:, :, 1])
            if last - first == 1:
                below[over[a]] += up[a:b].sum(axis=0)
            else:
                heads = f.families[first:last]
                below[over[heads]] += np.add.reduceat(up[a:b], heads - a, axis=0)
        whole = below.copy()
        for a, b, _, _ in levels[1:]:
            rest[a:b] = whole[over[a:b]] - up[a:b]  # what a node's parent says of all that is not below the node, in states of the parent
            t = rest[a:b, :, None] + table[a:b]
            own = below[a:b] + np.logaddexp(t[:, 0], t[:, 1])
            whole[a:b] = own - np.maximum(own[:, :1], own[:, 1:])
        content = np.empty(n)
        content[f.order] = 1 / (1 + np.exp(np.clip(whole[:, 0] - whole[:, 1], -500, 500)))
        if not edges:
            return content, None
        joint = rest[:, :, None] + table + below[:, None, :]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        pairs = np.zeros((n, 2, 2))
        pairs[f.order] = joint / joint.sum(axis=(1, 2), keepdims=True)
        pairs[f.parent < 0] = 0
        return content, pairs


def fit(pages: list[Page], steps: int = 120, rate: float = 0.3, ridge: float = 1e-5) -> TreeModel:
    """Maximum likelihood on labelled pages: the gradient is what the labels count less what the marginals expect."""
    forest = Forest.of(pages)
    labels = np.fromiter((x for p in pages for x in p.labels), np.int64, len(forest.parent))
    model = TreeModel(np.zeros(BUCKETS), np.zeros((EDGES, 2, 2)))
    child = np.flatnonzero(forest.parent >= 0)
    sizes = np.diff(forest.cuts)
    seen = np.zeros((EDGES, 2, 2))
    np.add.at(seen, (forest.edge[child], labels[forest.parent[child]], labels[child]), 1.0)
    momentum = [np.zeros_like(x) for p in (model.weights, model.edges) for x in (p, p)]
    for step in range(1, steps + 1):
        content, pairs = model.marginals(forest)
        grads = np.bincount(forest.at, np.repeat(labels - content, sizes), BUCKETS), seen.copy()
        np.add.at(grads[1], forest.edge[child], -pairs[child])
        for i, (p, g) in enumerate(zip((model.weights, model.edges), grads)):
            g = g / len(pages) - ridge * p
            mean, square = momentum[2 * i : 2 * i + 2]
            mean += 0.1 * (g - mean)
            square += 0.01 * (g * g - square)
            p += rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return model


@lru_cache(maxsize=4)
def trained(count: int = TRAINING, seed: int = 42) -> TreeModel:
    """The model of ``count`` labelled pages drawn by rule."""
    return fit([parse(p) for p in labelled_pages(count, seed)])


def main_text(page: Page, content: np.ndarray) -> str:
    """The page's content in order: white space is one space, a block's text is trimmed, blocks are joined by one space."""
    parts, broken = [], False
    for node, text, before in page.texts:
        broken |= before
        if node < 0 or content[node] >= 0.5:
            parts.append(" " + text if broken else text)
            broken = False
    return " ".join("".join(parts).split())


def extract(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """Per row: ``page_id``, ``url``, the main ``text`` of ``html`` (empty if none) and its code points ``n_chars``.

    Whole pages are read in one pass without a shuffle; a null page is empty; a very long or very deep one costs what its nodes do.  Null keys and repeated rows stay, other columns are not
    read.  The model's size is fixed by its parameters (40 KB) whatever the input.
    """
    text_batches(pages)
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            held: list[Page] = []

            def flush() -> None:
                content = model.marginals(Forest.of(held), edges=False)[0]
                at = 0
                for page in held:
                    texts.append(main_text(page, content[at : at + len(page.parent)]))
                    at += len(page.parent)
                held.clear()

            nodes = 0
            for source in batch.column(2):
                held.append(parse(source.as_py()))
                nodes += len(held[-1].parent)
                if nodes > NODES:
                    flush()
                    nodes = 0
            if held:
                flush()
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return read.mapInArrow(run, "page_id long, url string, text string, n_chars long")
