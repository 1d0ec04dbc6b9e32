"""Exact vector search by scans and by stored cells, mean pooling.

Items are never shuffled and never paired with queries as rows. Queries are broadcast in blocks of a bounded
size; a scan of the items scores Arrow batches against the block and a task sends only its best k per query,
so the rows sent are bounded by k x tasks x queries. A global ``row_number`` over them is exact.

``build_cells`` stores items in cells around pivots, with each cell's radius. A search then reads the cells
nearest to each query first; the k-th best score found is a threshold, and by the triangle inequality a cell whose
best possible score does not reach it is not read (the cell is a partition column, so it is pruned before the scan).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.stat import Summarizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HIGHER_IS_BETTER = {"dot": True, "cosine": True, "l2sq": False}
QUERY_BYTES = 16 << 20       # query vectors of a block
QUERIES_PER_BLOCK = 4096
ROWS_AT_ONCE = 4096          # items scored at once
CELLS_AT_ONCE = 1 << 20      # (query, item) scores at once
PAIRS_AT_ONCE = 1 << 17      # pairs taken exactly at once, and held before they are cut to the best
TIED = 2e-9                  # keys no further apart can be equal at 9 places
PIVOT_SAMPLE = 20_000        # rows on which the pivots are fitted; every row is stored and searched
PROBES = 2                   # cells of a query that set its threshold
PLACES = 9

HITS = "query_id long, item_id long, score double"


def matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    """Rows of a vector column; a missing vector is all zeros, a shorter one is filled up with zeros."""
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        if v is not None and dim:
            out[i, :len(v)] = v
    return out


def scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Scores of all (query, item); a cosine with a zero vector is 0."""
    if metric == "dot":
        return q @ x.T
    if metric == "cosine":
        den = np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1))
        return np.where(den > 0, (q @ x.T) / np.where(den > 0, den, 1.0), 0.0)
    if metric == "l2sq":
        out = np.empty((len(q), len(x)))
        for i in range(len(q)):               # one query at a time keeps memory at items x dim
            d = x - q[i]
            out[i] = np.einsum("ij,ij->i", d, d)
        return out
    raise ValueError(metric)


def best(key: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` smallest keys in order, ties by smaller id."""
    near = np.arange(len(key)) if len(key) <= k else np.flatnonzero(key <= np.partition(key, k - 1)[k - 1])
    return near[np.lexsort((ids[near], key[near]))[:k]]


def best_of_each(query: np.ndarray, key: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``k`` smallest keys of each query in order, ties by smaller id, and the places of the k-th ones."""
    order = np.lexsort((ids, key, query))
    rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
    return order[rank < k], order[rank == k - 1]


def near_pairs(q: np.ndarray, x: np.ndarray, metric: str, k: int, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Queries, items and scores of the pairs that can be among the ``k`` best of a query and whose key is at most ``least``.
    Distances are found by a product of all pairs, up to its rounding, and taken exactly for those that are near enough."""
    if metric == "l2sq":
        a, b = np.einsum("ij,ij->i", q, q)[:, None], np.einsum("ij,ij->i", x, x)
        key = a + b - 2 * (q @ x.T)
        error = 1e-11 * (a + b.max())[:, 0]
    else:
        key, error = -scores(q, x, metric), 0.0
    bound = least
    if len(x) > k:
        bound = np.minimum(bound, np.partition(key, k - 1, axis=1)[:, k - 1])
    open_to_all = len(x) <= k and not np.isfinite(least).any()
    found = np.arange(key.size) if open_to_all else np.flatnonzero(key <= (bound + TIED + 2 * error)[:, None])
    for at in range(0, len(found), PAIRS_AT_ONCE):
        i, j = np.divmod(found[at:at + PAIRS_AT_ONCE], len(x))
        if metric == "l2sq":
            d = x[j] - q[i]
            yield i, j, np.einsum("ij,ij->i", d, d)
        else:
            yield i, j, -key[i, j]


def scan(held, k: int, metric: str):
    """Pandas function over ``item_id, embedding[, cell]``: a task's best ``k`` items of each query.

    ``held``: broadcast (query ids, vectors, cells of each query or None)."""
    sign = -1.0 if HIGHER_IS_BETTER[metric] else 1.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, q, open_to = held.value
        least = np.full(len(qids), np.inf)                  # the key of a query's k-th best so far
        kept: list[tuple[np.ndarray, ...]] = []             # queries, ids, scores

        def cut():
            who, ids, s = (np.concatenate(x) for x in zip(*kept, strict=True))
            key = np.round(sign * s, PLACES)
            top, kth = best_of_each(who, key, ids, k)
            least[who[kth]] = np.minimum(least[who[kth]], key[kth])
            kept[:] = [(who[top], ids[top], s[top])]
            return kept[0]
        more = 0                                            # pairs since the last cut
        for pdf in batches:
            groups = [(None, pdf)] if open_to is None else pdf.groupby("cell", sort=False)
            for cell, rows in groups:
                who = np.arange(len(qids)) if cell is None else np.flatnonzero(open_to[:, cell])
                for at in range(0, len(rows) if len(who) else 0, ROWS_AT_ONCE):
                    part = rows.iloc[at:at + ROWS_AT_ONCE]
                    ids, x = part["item_id"].to_numpy(dtype=np.int64), matrix(part["embedding"], q.shape[1])
                    n = max(1, CELLS_AT_ONCE // len(ids))
                    for lo in range(0, len(who), n):
                        some = who[lo:lo + n]
                        for i, j, s in near_pairs(q[some], x, metric, k, least[some]):
                            kept.append((some[i], ids[j], s))
                            more += len(i)
                            if more > PAIRS_AT_ONCE:
                                cut()
                                more = 0
        if kept:
            who, ids, s = cut()
            yield pd.DataFrame({"query_id": qids[who], "item_id": ids, "score": s})
    return run


def arrow_batches(df: DataFrame) -> Iterator[pa.RecordBatch]:
    """The rows of ``df`` in order, a partition at a time, as Arrow batches: no object per value on the way to the driver."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, batch.schema) as w:
                w.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["batch"])
    for r in df.mapInArrow(pack, "batch binary").toLocalIterator():
        yield from pa.ipc.open_stream(bytes(r["batch"]))


def lists_of(column: pa.ListArray) -> list[np.ndarray | None]:
    """The lists of a column of numbers, None where there is none."""
    at, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[at[i]:at[i + 1]] if ok else None for i, ok in enumerate(column.is_valid().to_pylist())]


def query_blocks(queries: DataFrame, query_id: str, query_vec: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (ids, vectors) of at most ``QUERY_BYTES``; one block at a time is on the driver."""
    rows, size = [], 0

    def block():
        dim = max((len(v) for _, v in rows if v is not None), default=0)
        return np.array([i for i, _ in rows], dtype=np.int64), matrix(pd.Series([v for _, v in rows], dtype=object), dim)
    for batch in arrow_batches(queries.select(F.col(query_id).cast("long").alias("i"),
                                              F.col(query_vec).cast("array<double>").alias("v"))):
        for row in zip(batch.column("i").to_pylist(), lists_of(batch.column("v")), strict=True):
            rows.append(row)
            size += 8 * (0 if row[1] is None else len(row[1]))
            if size >= QUERY_BYTES or len(rows) == QUERIES_PER_BLOCK:
                yield block()
                rows, size = [], 0
    if rows:
        yield block()


def _items(items: DataFrame, item_id: str, item_vec: str, *more: str) -> DataFrame:
    return items.select(F.col(item_id).cast("long").alias("item_id"),
                        F.col(item_vec).cast("array<double>").alias("embedding"), *more)


def _ranked(hits: DataFrame, k: int, metric: str) -> DataFrame:
    """``query_id, rank, item_id, score, best``; ``best`` is the best score over all items."""
    order = F.round("score", PLACES)
    w = Window.partitionBy("query_id").orderBy(order.desc() if HIGHER_IS_BETTER[metric] else order.asc(), "item_id")
    top = F.max("score") if HIGHER_IS_BETTER[metric] else F.min("score")
    wb = Window.partitionBy("query_id")
    return (hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .withColumn("best", top.over(wb)).select("query_id", "rank", "item_id", "score", "best"))


def _union(parts: list[DataFrame], spark: SparkSession) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], HITS)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def top_k(items: DataFrame, queries: DataFrame, k: int, metric: str = "dot", item_id: str = "item_id",
          item_vec: str = "embedding", query_id: str = "query_id", query_vec: str = "embedding") -> DataFrame:
    """Exact top-k items per query by a scan: ``query_id, rank, item_id, score, best``.

    ``best`` is the best score over all items (the per-query maximum of A5). Ties break by smaller item
    id; a missing vector counts as zeros. Filters on ``items`` reach its scan.
    """
    send, rows = items.sparkSession.sparkContext.broadcast, _items(items, item_id, item_vec)
    found = [rows.mapInPandas(scan(send((ids, q, None)), k, metric), HITS)
             for ids, q in query_blocks(queries, query_id, query_vec)]
    return _ranked(_union(found, items.sparkSession), k, metric)


# --- stored cells -----------------------------------------------------------------------------------------

def fit_pivots(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Pivots by a few rounds of k-means from evenly spread rows; any pivots give exact results."""
    pivots = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(sample, pivots)[0]
        for c in range(len(pivots)):
            if (near == c).any():
                pivots[c] = sample[near == c].mean(axis=0)
    return pivots


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each row, and the distance to it."""
    d = np.maximum((x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * x @ pivots.T, 0)
    at = d.argmin(axis=1)
    return at, np.linalg.norm(x - pivots[at], axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def build_cells(items: DataFrame, path: str, metric: str = "l2sq", cells: int = 64, item_id: str = "item_id",
                item_vec: str = "embedding", carry: tuple = ()) -> str:
    """Store ``items`` in ``path``: ``items`` (``item_id, embedding``, columns ``carry``) by ``cell``, and ``cells``
    (``cell, pivot, radius, n``). Pivots come from at most ``PIVOT_SAMPLE`` rows; all rows are stored. For cosine
    the cells are those of the unit vectors. A cell that holds many rows is several files."""
    rows = _items(items, item_id, item_vec, *carry)
    dim = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    dim = max(dim, 0)                                       # size of a null vector is -1
    sample = rows.filter(F.col("embedding").isNotNull()).orderBy(F.xxhash64("item_id"), "item_id").limit(PIVOT_SAMPLE)
    x = matrix(sample.select("embedding").toPandas()["embedding"], dim)
    pivots = fit_pivots(_unit(x) if metric == "cosine" else x, cells) if len(x) else np.zeros((1, dim))
    held = items.sparkSession.sparkContext.broadcast(pivots)
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())])

    def assign(batches):
        for pdf in batches:
            v = matrix(pdf["embedding"], dim)
            cell, away = nearest(_unit(v) if metric == "cosine" else v, held.value)
            yield pdf.assign(cell=cell.astype(np.int32), away=away)
    dealt = rows.mapInPandas(assign, schema).repartitionByRange("cell", F.xxhash64("item_id"))
    dealt.write.partitionBy("cell").parquet(f"{path}/items")
    stored = items.sparkSession.read.schema(dealt.schema).parquet(f"{path}/items")
    meta = stored.groupBy("cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n"))
    table = items.sparkSession.createDataFrame([(i, p.tolist()) for i, p in enumerate(pivots)], "cell int, pivot array<double>")
    meta.join(table, "cell").write.parquet(f"{path}/cells")
    return path


def reachable(q: np.ndarray, pivots: np.ndarray, radius: np.ndarray, metric: str) -> np.ndarray:
    """The best score that an item of each cell can have for each query (rounded outwards), as a key: smaller is
    better. dot: q.x <= q.p + |q| r; cosine: the same on unit vectors; l2sq: (max(0, |q - p| - r))^2."""
    if metric == "l2sq":
        d = np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * q @ pivots.T, 0))
        return np.maximum(d - radius[None, :] - 1e-6 * (1 + d), 0) ** 2
    u = _unit(q) if metric == "cosine" else q
    most = u @ pivots.T + np.linalg.norm(u, axis=1)[:, None] * radius[None, :]
    if metric == "cosine":
        most = np.maximum(most, 0.0)                        # zero vectors score 0
    return -(most + 1e-9 * (1 + np.abs(most)))


def search_cells(spark: SparkSession, path: str, queries: DataFrame, k: int, metric: str = "l2sq", where=None,
                 query_id: str = "query_id", query_vec: str = "embedding", report: list | None = None) -> DataFrame:
    """As ``top_k`` over stored cells, reading only those that can hold a result. ``where``: a condition on the
    stored columns. ``report`` gets the numbers of (query, cell) searches done and of all."""
    meta = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()        # a row per cell
    if not meta:
        return _ranked(_union([], spark), k, metric)
    stored = spark.read.parquet(f"{path}/items")
    stored = stored if where is None else stored.filter(where)
    send, sign = spark.sparkContext.broadcast, -1.0 if HIGHER_IS_BETTER[metric] else 1.0
    found = []
    cells = np.array([r["cell"] for r in meta])
    radius = np.array([r["radius"] for r in meta])
    pivots = np.array([r["pivot"] for r in meta])

    def search(ids, q, chosen):
        open_to = np.zeros((len(ids), cells.max() + 1), dtype=bool)
        open_to[:, cells] = chosen
        some = stored.filter(F.col("cell").isin(cells[chosen.any(axis=0)].tolist()))
        return some.select("item_id", "embedding", "cell").mapInPandas(scan(send((ids, q, open_to)), k, metric), HITS)

    for ids, q in query_blocks(queries, query_id, query_vec):
        q = np.pad(q, ((0, 0), (0, max(0, pivots.shape[1] - q.shape[1]))))[:, :max(pivots.shape[1], q.shape[1])]
        p = np.pad(pivots, ((0, 0), (0, q.shape[1] - pivots.shape[1])))
        bound = reachable(q, p, radius, metric)
        first = np.zeros(bound.shape, dtype=bool)
        np.put_along_axis(first, np.argsort(bound, axis=1, kind="stable")[:, :PROBES], True, axis=1)
        near = search(ids, q, first)
        hits = _ranked(near, k, metric).select("query_id", "item_id", "score", "rank").collect()    # k per query
        least = np.full(len(ids), math.inf)
        at = {i: n for n, i in enumerate(ids.tolist())}
        for r in hits:
            if r["rank"] == k:
                least[at[r["query_id"]]] = sign * r["score"]
        rest = ~first & (bound <= least[:, None] + 1e-8 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))[:, None])
        if report is not None:
            report.append((int(first.sum() + rest.sum()), first.size))
        found.append(spark.createDataFrame([(r["query_id"], r["item_id"], r["score"]) for r in hits], HITS))
        if rest.any():
            found.append(search(ids, q, rest))
    return _ranked(_union(found, spark), k, metric)


def mean_pool(chunks: DataFrame, key: str, vec: str = "embedding") -> DataFrame:
    """Mean of the vectors of each key, position by position (A8): one partial and one final aggregate of the
    vectors themselves; rows without a vector do not count."""
    v = chunks.filter(F.col(vec).isNotNull()).select(key, array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))
    return v.groupBy(key).agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias(vec))
