"""Hard negatives of anchors by spanning-tree bounds on inner products.

The anchors of a label form minimum spanning trees (of at most ``TREE`` anchors each). A root is
scored against all candidates. A child's score of a candidate x lies within its parent's score (or
the parent's own bounds) plus or minus edge length times norm of x; only candidates whose
bounds overlap the window that the child still needs are scored.

Two scans of the table for each block of anchors: first the positives (the best rows of the anchor's
label), then, with the windows that they set, the negatives. A block of anchors is broadcast and bounded
by ``BLOCK_BYTES``; a task keeps the few best rows of an anchor and sends no others. Windows start
from what the block's own anchors score among themselves, so that the rows sent do not grow with
the number of tasks; every row is looked at, so the result is exact.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take no part;
a shorter vector counts as filled up with zeros; equal scores go by smaller id; repeated rows each
take a place among positives and negatives, a row with the anchor's own id never; of several rows
with an anchor's id that with the smallest (label, vector) is the anchor; an empty table or no anchors give
no rows; columns other than the three named ones are not read. Scores must stay below 2**53.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glint.llm.bpe import spread_out
from glint.llm.common import stored

BLOCK_BYTES = 32 << 20     # vectors of the anchors that a scan serves
TREE = 1024                # anchors of a tree
ROWS = 8192                # candidates that are bounded at a time
SEEDS = 2048               # anchors of a block that set the first windows

POSITIVES = "anchor_id long, item_id long, score long"
NEGATIVES = ("anchor_id long, place int, positive_id long, negative_id long, positive_score long, "
             "negative_score long")


def usable(items: DataFrame, item_id: str, label: str, vec: str) -> DataFrame:
    """``item_id, label, vec`` of the rows that take part."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return items.filter(F.col(item_id).isNotNull() & F.col(label).isNotNull() & F.col(vec).isNotNull() & finite).select(
        F.col(item_id).cast("long").alias("item_id"), F.col(label).cast("long").alias("label"),
        F.col(vec).cast("array<double>").alias("vec"))


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled up with zeros."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(vectors) * dim:
        return flat.reshape(len(vectors), dim)
    sizes = np.array([len(v) for v in vectors], dtype=np.int64)
    out = np.zeros(len(vectors) * dim)
    out[spread_out(np.arange(len(vectors)) * dim, sizes)] = flat
    return out.reshape(len(vectors), dim)


def spanning_tree(v: np.ndarray) -> list[tuple[int, int, float]]:
    """(node, parent, edge length) of a minimum spanning tree, parents first and depth first; the root's
    parent is -1. Lengths are rounded up."""
    n, square = len(v), (v * v).sum(axis=1)
    near, parent, out = np.full(n, np.inf), np.full(n, -1), np.ones(n, dtype=bool)
    edge, at = np.zeros(n), 0
    for _ in range(n):
        out[at] = False
        d = np.maximum(square + square[at] - 2 * (v @ v[at]), 0)
        closer = out & (d < near)
        near[closer], parent[closer] = d[closer], at
        if out.any():
            nxt = int(np.argmin(np.where(out, near, np.inf)))
            edge[nxt], at = math.sqrt(near[nxt]) * (1 + 1e-9), nxt
    children = [[] for _ in range(n)]
    for i in range(1, n):
        children[parent[i]].append(i)
    order, stack = [], [0] if n else []
    while stack:
        i = stack.pop()
        order.append((i, int(parent[i]), float(edge[i])))
        stack.extend(children[i])
    return order


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, in order; ties by smaller id."""
    place = np.arange(len(scores))
    if len(scores) > k:
        place = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return place[np.lexsort((ids[place], -scores[place]))][:k]


def walk(tree: list, anchors: np.ndarray, x: np.ndarray, norm: np.ndarray, need):
    """Scores of the rows ``x`` that each anchor of a tree needs: (anchor, places, scores).

    ``need(anchor)`` gives the lowest and highest score that still matter to it.
    """
    bounds, waiting = {}, {}
    for _, p, _ in tree:
        waiting[p] = waiting.get(p, 0) + 1
    for node, p, edge in tree:
        if p < 0:
            low = x @ anchors[node]
            high, place = low, np.arange(len(x))
            scores = low
        else:
            reach = edge * norm
            low, high = bounds[p][0] - reach, bounds[p][1] + reach
            least, most = need(node)
            place = np.flatnonzero((high >= least) & (low <= most))
            scores = (x if len(place) == len(x) else x[place]) @ anchors[node]
            low[place] = high[place] = scores
        if node in waiting:
            bounds[node] = low, high
        if p >= 0:
            waiting[p] -= 1
            if not waiting[p]:
                del bounds[p]
        yield node, place, scores


class Block:
    """A block of anchors: ids, labels, vectors, and the trees of each label."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors, self.dim = ids, labels, vectors, vectors.shape[1]
        self.trees = []                  # (label, anchors of the tree, tree)
        for label in np.unique(labels).tolist():
            mine = np.flatnonzero(labels == label)
            for i in range(0, len(mine), TREE):
                part = mine[i:i + TREE]
                self.trees.append((label, part, spanning_tree(vectors[part])))

    def scored(self, batches, wanted, need):
        """Of all candidates that ``wanted(label of a tree, labels)`` marks: (anchor, ids, scores)."""
        for batch in batches:
            x = matrix(batch.column("vec"), self.dim)
            ids, labels = batch.column("item_id").to_numpy(), batch.column("label").to_numpy()
            norm = np.sqrt((x * x).sum(axis=1)) * (1 + 1e-9) + 1e-9
            for label, part, tree in self.trees:
                rows = np.flatnonzero(wanted(label, labels))
                for i in range(0, len(rows), ROWS):
                    r = rows[i:i + ROWS]
                    for node, place, scores in walk(tree, self.vectors[part], x[r], norm[r],
                                                    lambda n, part=part: need(int(part[n]))):
                        yield int(part[node]), ids[r[place]], scores


def first_positive_bounds(block: Block, k: int) -> np.ndarray:
    """Of each anchor the k-th best score among other anchors of its tree: no worse row is a positive."""
    out = np.full(len(block.ids), -np.inf)
    for _, part, _ in block.trees:
        if len(part) > k:
            s = block.vectors[part] @ block.vectors[part].T
            np.fill_diagonal(s, -np.inf)
            out[part] = np.partition(s, len(part) - k, axis=1)[:, len(part) - k]
    return out


def positives_of(held, k: int):
    """Arrow function: a task's best ``k`` rows of each anchor's label, in no order. ``held``: a broadcast
    block and the scores below which no row of an anchor's label is a positive."""
    def run(batches):
        block, seeds = held.value
        least = seeds.copy()
        kept = {}
        for a, ids, scores in block.scored(batches, lambda label, labels: labels == label,
                                           lambda a: (least[a], np.inf)):
            ok = (scores >= least[a]) & (ids != block.ids[a])
            if ok.any():
                s, i = scores[ok], ids[ok]
                if a in kept:
                    s, i = np.append(kept[a][0], s), np.append(kept[a][1], i)
                top = best(s, i, k)
                kept[a] = s[top], i[top]
                if len(top) == k:
                    least[a] = max(least[a], s[top[-1]])
        for a, (s, i) in kept.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(s), block.ids[a])), pa.array(i), pa.array(s.astype(np.int64))],
                names=["anchor_id", "item_id", "score"])
    return run


class Windows:
    """Of each anchor its positives, and of each positive the lowest score that is still of use."""

    def __init__(self, block: Block, positives: list[tuple], k: int, low: int, high: int):
        self.k, self.low, self.high = k, low, high
        at = {i: n for n, i in enumerate(block.ids.tolist())}
        self.of = [[] for _ in at]                      # (positive id, its score), best first
        for anchor, item, score in positives:
            self.of[at[anchor]].append((item, score))
        self.least = []
        some = np.linspace(0, len(at) - 1, min(SEEDS, len(at))).astype(int) if at else np.zeros(0, int)
        for a, found in enumerate(self.of):
            scores = np.zeros(0)
            if found:
                other = some[block.labels[some] != block.labels[a]]
                scores = block.vectors[other] @ block.vectors[a]
            bounds = []
            for _, p in found:
                inside = scores[self.inside(scores, p)]
                bounds.append(np.partition(inside, len(inside) - k)[len(inside) - k] if len(inside) >= k else -np.inf)
            self.least.append(bounds)

    def inside(self, scores: np.ndarray, positive: int) -> np.ndarray:
        return (self.low * positive <= 100 * scores) & (100 * scores <= self.high * positive)

    def need(self, a: int, least: list) -> tuple[float, float]:
        """Lowest and highest score that some positive of the anchor still needs (rounded outwards)."""
        if not self.of[a]:
            return np.inf, -np.inf
        low = min(max(b, self.low * p / 100 - 1) for (_, p), b in zip(self.of[a], least[a], strict=True))
        return low, max(self.high * p / 100 + 1 for _, p in self.of[a])


def negatives_of(held):
    """Arrow function: for each anchor and positive a task's best rows of other labels in the window.
    ``held``: a broadcast block and its windows."""
    def run(batches):
        block, windows = held.value
        least, kept = [list(b) for b in windows.least], {}
        for a, ids, scores in block.scored(batches, lambda label, labels: labels != label,
                                           lambda a: windows.need(a, least)):
            for j, (_, p) in enumerate(windows.of[a]):
                ok = windows.inside(scores, p) & (scores >= least[a][j]) & (ids != block.ids[a])
                if ok.any():
                    s, i = scores[ok], ids[ok]
                    if (a, j) in kept:
                        s, i = np.append(kept[a, j][0], s), np.append(kept[a, j][1], i)
                    top = best(s, i, windows.k)
                    kept[a, j] = s[top], i[top]
                    if len(top) == windows.k:
                        least[a][j] = max(least[a][j], s[top[-1]])
        for (a, j), (s, i) in kept.items():
            item, p = windows.of[a][j]
            n = len(s)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, block.ids[a])), pa.array(np.full(n, j, dtype=np.int32)),
                 pa.array(np.full(n, item)), pa.array(i), pa.array(np.full(n, p)), pa.array(s.astype(np.int64))],
                names=[f.split()[0] for f in NEGATIVES.split(", ")])
    return run


def _leading(rows: DataFrame, keys: list[str], item: str, score: str, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(item))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(items: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         item_id: str = "vec_id", label: str = "label", vec: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchor`` marks the anchors among ``items``, whose vectors hold whole numbers. An anchor's positives are
    its ``positives`` best other rows of the same label; of each, the ``negatives`` best rows of other labels
    with ``low`` to ``high`` per cent of the positive's score are returned.
    """
    rows = usable(items, item_id, label, vec)
    given = usable(items.filter(anchor), item_id, label, vec)
    anchors = stored(given.groupBy("item_id").agg(F.min(F.struct("label", "vec")).alias("v"))
                     .select("item_id", "v.label", "v.vec"), "anchors")
    dim = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    blocks = max(1, math.ceil(anchors.count() * max(dim, 1) * 8 / BLOCK_BYTES))
    send = items.sparkSession.sparkContext.broadcast
    out = []
    for n in range(blocks):
        part = anchors.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == n).toArrow().sort_by("item_id")
        block = Block(part.column("item_id").to_numpy(), part.column("label").to_numpy(),
                      matrix(part.column("vec").combine_chunks(), dim))
        held = send((block, first_positive_bounds(block, positives)))
        found = _leading(rows.mapInArrow(positives_of(held, positives), POSITIVES), ["anchor_id"], "item_id", "score",
                         positives)
        found = [(r["anchor_id"], r["item_id"], r["score"]) for r in found.orderBy("anchor_id", "rank").collect()]
        held = send((block, Windows(block, found, negatives, low, high)))
        out.append(_leading(rows.mapInArrow(negatives_of(held), NEGATIVES), ["anchor_id", "place"], "negative_id",
                            "negative_score", negatives))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
