"""Hybrid scores of many queries that have most of their terms in common, as queries made from one form do.

Queries whose common terms (those that many of the queries ask for), window and lack of a vector agree are of one
kind. The keyword score of a document is that of the kind, worked out once, and what the query's other terms add where
a document has them. So a document without a vector is ranked per kind, with the queries' own postings beside it, and
only documents and queries that both have a vector are a matrix product of all pairs. The two scans and the formula are
those of ``glint.operators.scoring``, and every document counts:

* maxima of both scores per query. A task also gives the keyword score of its semantically nearest document: of the
  combined scores of these documents, one per task, the k-th best is a threshold that every result reaches;
* pairs that reach the threshold (or the least relevance asked for) are scored in full, and the task's top k kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glint.operators.text_index import K1, RANK_PLACES, B
from glint.operators.vectors import best_of_each, matrix

OFTEN = 8                       # queries (or a sixteenth of them) that make a term a common one
PER_KIND = 8                    # queries of a kind, on average, from which on kinds pay
RARELY = 64                     # of so many pairs of a query and a document at most one shares a term that is not common
FOLDED = 32                     # kinds of a matrix product that are taken into it
EXPAND_LIMIT = 4_000_000        # (posting, query) pairs expanded at once
CELLS_AT_ONCE = 1 << 20         # (query, document) scores at once
ROWS_AT_ONCE = 4096             # documents scored at once
KEPT_AT_ONCE = 1 << 18          # pairs held before they are cut to the top k
CROWDED = 16                    # share of the pairs that reach a threshold, from which on it is raised first
SLACK = 2e-9                    # scores are ranked at 9 places

MAXIMA = "place int, max_bm25 double, max_sem double, bm25_there double"


@dataclass
class Asked:
    """A query as it was gathered: window in micros (NaN: open), terms by code with their weights."""

    query_id: int
    vector: np.ndarray | None
    start: float
    end: float
    codes: np.ndarray
    weights: np.ndarray


@dataclass
class AlikeQueries:
    """Queries in the order of their kinds, those with a vector first."""

    ids: np.ndarray
    vectors: np.ndarray          # of the queries that have one
    kind: np.ndarray
    bounds: np.ndarray           # where the queries of each kind begin, and the end
    weights: np.ndarray          # of each kind and common term
    starts: np.ndarray           # of each kind
    ends: np.ndarray
    bare: np.ndarray             # kinds whose queries have no vector
    common: np.ndarray           # place of each term among the common ones, or -1
    first: np.ndarray            # where the (query, weight) pairs of each other term begin, and the end
    query: np.ndarray
    weight: np.ndarray
    avgdl: float
    scale: float

    def slices(self, batches: Iterator[pd.DataFrame]) -> Iterator[Scored]:
        n = max(1, min(ROWS_AT_ONCE, CELLS_AT_ONCE // max(len(self.starts), 1)))
        for pdf in batches:
            for at in range(0, len(pdf), n):
                yield Scored(self, pdf.iloc[at:at + n])


def alike_queries(asked: list[Asked], df: list[int], n_docs: int, avgdl: float, scale: float) -> AlikeQueries | None:
    """The queries by kinds; None if they differ too much for kinds to pay. ``df``: documents of each term."""
    n = len(asked)
    codes = np.concatenate([a.codes for a in asked])
    weights = np.concatenate([a.weights for a in asked])
    who = np.repeat(np.arange(n), [len(a.codes) for a in asked])
    size = np.bincount(codes, minlength=len(df))
    often = size >= max(OFTEN, n // 16)
    often[codes[weights < 0]] = True                        # what other terms add is never below 0
    if (size * np.array(df, dtype=float))[~often].sum() * RARELY > n * n_docs:
        return None
    kinds: dict[tuple, int] = {}
    of = np.empty(n, dtype=np.int64)
    for i, a in enumerate(asked):
        here = np.flatnonzero(often[a.codes])
        here = here[np.argsort(a.codes[here])]
        key = (a.vector is None, a.start if a.start == a.start else None, a.end if a.end == a.end else None,
               a.codes[here].tobytes(), a.weights[here].tobytes())
        of[i] = kinds.setdefault(key, len(kinds))
        if len(kinds) * PER_KIND > n + PER_KIND:
            return None
    order = np.lexsort((of, [a.vector is None for a in asked]))
    some, first_of, kind, held = np.unique(of[order], return_index=True, return_inverse=True, return_counts=True)
    by_place = np.argsort(first_of)                         # kinds numbered as they come in the order of the queries
    kind, held = np.argsort(by_place)[kind], held[by_place]
    one = [asked[i] for i in order[np.sort(first_of)]]
    common = np.where(often, np.cumsum(often) - 1, -1)
    table = np.zeros((len(some), int(often.sum())))
    for i, a in enumerate(one):
        here = often[a.codes]
        table[i, common[a.codes[here]]] = a.weights[here]
    place = np.argsort(order)
    rare = ~often[codes]
    by_term = np.argsort(codes[rare], kind="stable")
    vectors = [asked[i].vector for i in order if asked[i].vector is not None]
    return AlikeQueries(
        np.array([asked[i].query_id for i in order], dtype=np.int64),
        matrix(pd.Series(vectors, dtype=object), max((len(v) for v in vectors), default=0)),
        kind, np.append(0, np.cumsum(held)), table, np.array([a.start for a in one]), np.array([a.end for a in one]),
        np.array([a.vector is None for a in one]), common,
        np.append(0, np.cumsum(np.where(often, 0, size))), place[who[rare]][by_term], weights[rare][by_term], avgdl, scale)


class Scored:
    """Documents of a scan against all queries: keyword scores per kind, and what single queries' terms add to them."""

    def __init__(self, queries: AlikeQueries, rows: pd.DataFrame):
        self.queries, self.ids, nd = queries, rows["doc_id"].to_numpy(), len(rows)
        doc = np.repeat(np.arange(nd), rows["codes"].map(len).to_numpy(dtype=np.int64))
        code = np.concatenate([*rows["codes"], np.array([], np.int64)]).astype(np.int64)
        tf = np.concatenate([*rows["tfs"], np.array([], np.int64)]).astype(float)
        length = rows["dl"].to_numpy(dtype=float)[doc]
        part = tf * queries.scale / (tf + K1 * (1 - B + B * length / queries.avgdl))
        at = queries.common[code] >= 0
        parts = np.zeros((queries.weights.shape[1], nd))
        parts[queries.common[code[at]], doc[at]] = part[at]
        self.base = queries.weights @ parts                 # by kind
        t = rows["_t"].to_numpy(dtype=float)[None, :]
        with np.errstate(invalid="ignore"):
            self.inside = ((np.isnan(queries.starts)[:, None] | (t >= queries.starts[:, None]))
                           & (np.isnan(queries.ends)[:, None] | (t <= queries.ends[:, None])))
        self.whole = bool(self.inside.all())
        known = rows["embedding"].notna().to_numpy()
        self.near = np.flatnonzero(known)                   # documents with a vector
        self.x = matrix(rows["embedding"].iloc[self.near], queries.vectors.shape[1])
        self.column = np.cumsum(known) - 1
        self.plain = self.inside & (queries.bare[:, None] | ~known[None, :])    # ranked without a vector
        self._own(code[~at], doc[~at], part[~at], nd)

    def _own(self, code: np.ndarray, doc: np.ndarray, part: np.ndarray, nd: int) -> None:
        """``key`` (query * documents + document, in order) and ``more`` of the pairs that share a term that is not
        common, inside the query's window."""
        q = self.queries
        size = (q.first[1:] - q.first[:-1])[code]
        upto = np.append(0, np.cumsum(size))
        keys, sums, lo = [np.array([], np.int64)], [np.array([])], 0
        while lo < len(code):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + EXPAND_LIMIT, side="right")) - 1)
            n = size[lo:hi]
            pair = np.repeat(q.first[code[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            posting = np.repeat(np.arange(lo, hi), n)
            keys.append(q.query[pair] * nd + doc[posting])
            sums.append(q.weight[pair] * part[posting])
            lo = hi
        self.key, at = np.unique(np.concatenate(keys), return_inverse=True)
        self.more = np.bincount(at, np.concatenate(sums), len(self.key))
        ok = self.inside[q.kind[self.key // nd], self.key % nd]
        self.key, self.more = self.key[ok], self.more[ok]

    def own(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries from ``lo`` to ``hi``, documents and sums of such pairs."""
        nd = len(self.ids)
        a, b = np.searchsorted(self.key, [lo * nd, hi * nd])
        return self.key[a:b] // nd, self.key[a:b] % nd, self.more[a:b]

    def added(self, query: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """What terms that are not common add to the score of each pair; NaN: the pair shares none."""
        key = query * len(self.ids) + doc
        at = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        if not len(self.key):
            return np.full(len(key), np.nan)
        return np.where(self.key[at] == key, self.more[at], np.nan)

    def panels(self) -> Iterator[tuple[int, int]]:
        """Ranges of queries with a vector, few enough at once that their scores with all documents that have one stay small."""
        n = max(1, CELLS_AT_ONCE // max(len(self.near), 1))
        for lo in range(0, len(self.queries.vectors) if len(self.near) else 0, n):
            yield lo, min(lo + n, len(self.queries.vectors))

    def outside(self, lo: int, hi: int) -> np.ndarray:
        return ~self.inside[self.queries.kind[lo:hi]][:, self.near]


def maxima(held):
    """Pandas function over the coded rows of documents: the task's maxima of each query."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = held.value
        most, there = np.zeros((2, len(q.ids))), np.zeros(len(q.ids))   # not above 0: the score counts as 0
        for s in q.slices(batches):
            of_kind = np.where(s.inside, s.base, -np.inf).max(axis=1, initial=-np.inf)
            most[0] = np.maximum(most[0], of_kind[q.kind])
            query, doc, more = s.own(0, len(q.ids))
            np.maximum.at(most[0], query, s.base[q.kind[query], doc] + more)
            for lo, hi in s.panels():
                sem = q.vectors[lo:hi] @ s.x.T
                if not s.whole:
                    sem[s.outside(lo, hi)] = -np.inf
                at = sem.argmax(axis=1)
                top = sem[np.arange(hi - lo), at]
                up = np.flatnonzero(top > most[1, lo:hi])
                most[1, lo + up], there[lo + up] = top[up], s.base[q.kind[lo + up], s.near[at[up]]]
        some = np.flatnonzero((most > 0).any(axis=0))
        yield pd.DataFrame({"place": some.astype(np.int32), "max_bm25": most[0][some], "max_sem": most[1][some],
                            "bm25_there": there[some]})
    return run


class Kept:
    """The task's top ``k`` of each query, and the score that a pair must reach."""

    def __init__(self, most: np.ndarray, least: np.ndarray, k: int, w_bm25: float, w_sem: float):
        self.most, self.least, self.k, self.w = most, least.copy(), k, (w_bm25, w_sem)
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.held = 0                                       # pairs since the last cut

    def add(self, query: np.ndarray, ids: np.ndarray, bm: np.ndarray, sem: np.ndarray) -> None:
        share = [np.where(m > 0, s / np.where(m > 0, m, 1.0), 0.0) for s, m in ((bm, self.most[0, query]), (sem, self.most[1, query]))]
        score = self.w[0] * share[0] + self.w[1] * share[1]
        ok = score >= self.least[query]
        if ok.any():
            self.rows.append(tuple(x[ok] for x in (query, ids, bm, sem, score)))
            self.held += int(ok.sum())
            if self.held > KEPT_AT_ONCE:
                self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        query, ids, bm, sem, score = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        top, kth = best_of_each(query, np.round(-score, RANK_PLACES), ids, self.k)
        self.least[query[kth]] = np.maximum(self.least[query[kth]], score[kth] - SLACK)
        self.rows = [tuple(x[top] for x in (query, ids, bm, sem, score))]
        self.held = 0
        return self.rows[0]


def _near(s: Scored, kept: Kept, factor: np.ndarray) -> None:
    """Pairs of queries and documents that both have a vector."""
    q, width = s.queries, len(s.near)
    for lo, hi in s.panels():
        kinds, at = np.unique(q.kind[lo:hi], return_inverse=True)
        left = q.vectors[lo:hi] * factor[1, lo:hi, None]
        if len(kinds) <= FOLDED:                            # the keyword scores are columns of the same product
            share = np.zeros((hi - lo, len(kinds)))
            share[np.arange(hi - lo), at] = factor[0, lo:hi]
            score = np.hstack([left, share]) @ np.vstack([s.x.T, s.base[kinds][:, s.near]])
        else:
            score = left @ s.x.T
            score += factor[0, lo:hi, None] * s.base[kinds][:, s.near][at]
        query, doc, more = s.own(lo, hi)
        there = s.column[doc]
        with_vector = (there >= 0) & (s.near[np.maximum(there, 0)] == doc)
        query, there, more = query[with_vector], there[with_vector], more[with_vector]
        score[query - lo, there] += factor[0, query] * more
        if not s.whole:
            score[s.outside(lo, hi)] = -np.inf
        found = np.flatnonzero(score >= kept.least[lo:hi, None])
        if len(found) * CROWDED > score.size and width > kept.k:
            kth = np.partition(score, width - kept.k, axis=1)[:, width - kept.k]
            kept.least[lo:hi] = np.maximum(kept.least[lo:hi], kth - SLACK)
            found = np.flatnonzero(score >= kept.least[lo:hi, None])
        for at in range(0, len(found), KEPT_AT_ONCE):
            query, column = np.divmod(found[at:at + KEPT_AT_ONCE], width)
            query, doc = query + lo, s.near[column]
            bm = s.base[q.kind[query], doc] + np.nan_to_num(s.added(query, doc))
            kept.add(query, s.ids[doc], bm, np.einsum("ij,ij->i", q.vectors[query], s.x[column]))


def leading(base: np.ndarray, ids: np.ndarray, k: int, apart: float, by_id: bool) -> np.ndarray:
    """Places of the documents that can be in the top ``k`` of a query: their score is a multiple of ``base`` and the
    id decides among scores up to ``apart`` from each other. Of equal ones ``k`` are enough. ``by_id``: all may be equal."""
    some = np.arange(len(base))
    if len(base) > k:
        some = np.flatnonzero(base >= np.partition(base, len(base) - k)[len(base) - k] - apart)
    some = some[np.lexsort((ids[some], -base[some]))]
    value = -base[some]
    some = some[np.arange(len(some)) - np.searchsorted(value, value) < k]
    return np.union1d(some, np.argsort(ids, kind="stable")[:k]) if by_id else some


def _plain(s: Scored, kept: Kept, factor: np.ndarray) -> None:
    """Pairs of which the query or the document has no vector."""
    q = s.queries
    for kind in np.flatnonzero(s.plain.any(axis=1)).tolist():
        lo, hi = q.bounds[kind], q.bounds[kind + 1]
        docs = np.flatnonzero(s.plain[kind])
        base, by, least = s.base[kind, docs], factor[0, lo:hi], kept.least[lo:hi]
        if not (by * max(base.max(), 0.0) >= least).any():
            continue
        above = by[by > 0]
        docs = docs[leading(base, s.ids[docs], kept.k, SLACK / above.min() if len(above) else 0.0, bool((by <= 0).any()))]
        query, at = np.nonzero(by[:, None] * s.base[kind, docs][None, :] >= least[:, None])
        query, doc = query + lo, docs[at]
        alone = np.isnan(s.added(query, doc))               # the others come below
        query, doc = query[alone], doc[alone]
        kept.add(query, s.ids[doc], s.base[kind, doc], np.zeros(len(doc)))
    query, doc, more = s.own(0, len(q.ids))
    here = s.plain[q.kind[query], doc]
    query, doc, more = query[here], doc[here], more[here]
    kept.add(query, s.ids[doc], s.base[q.kind[query], doc] + more, np.zeros(len(doc)))


def top(held, bounds, k: int, w_bm25: float, w_sem: float, columns: list[str]):
    """Pandas function over the coded rows of documents: the task's top ``k`` of each query that reach its threshold.
    ``bounds``: broadcast (maxima per query, threshold per query)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, (most, least) = held.value, bounds.value
        kept = Kept(most, least, k, w_bm25, w_sem)
        factor = np.where(most > 0, 1.0 / np.where(most > 0, most, 1.0), 0.0) * np.array([[w_bm25], [w_sem]])
        for s in q.slices(batches):
            _near(s, kept, factor)
            _plain(s, kept, factor)
        if kept.rows:
            query, *rest = kept.cut()
            yield pd.DataFrame(dict(zip(columns, [q.ids[query], *rest], strict=True)))
    return run


def alike_topk(rows: DataFrame, q: AlikeQueries, k: int, min_relevance: float, w_bm25: float, w_sem: float,
               schema: str) -> DataFrame:
    """The tasks' best rows (``schema``) of the queries over coded rows of documents, which should be stored."""
    def share(score, most, w):
        return F.when(F.col(most) > 0, F.lit(w) * score / F.col(most)).otherwise(F.lit(0.0))
    send = rows.sparkSession.sparkContext.broadcast
    held = send(q)
    found = rows.mapInPandas(maxima(held), MAXIMA).groupBy("place").agg(
        F.max("max_bm25").alias("b"), F.max("max_sem").alias("s"),
        F.collect_list(F.when(F.col("max_sem") > 0, F.struct(F.col("max_sem").alias("sem"), F.col("bm25_there").alias("bm")))).alias("near"))
    scores = F.transform("near", lambda x: share(x["bm"], "b", w_bm25) + share(x["sem"], "s", w_sem))
    most, least = np.full((2, len(q.ids)), -1.0), np.full(len(q.ids), -np.inf)
    for r in found.select("place", "b", "s", F.get(F.sort_array(scores, False), k - 1).alias("kth")).toLocalIterator():
        most[:, r["place"]] = r["b"], r["s"]
        least[r["place"]] = -np.inf if r["kth"] is None else r["kth"]
    bounds = send((most, np.maximum(least, min_relevance) - SLACK))
    return rows.mapInPandas(top(held, bounds, k, w_bm25, w_sem, [f.split()[0] for f in schema.split(", ")]), schema)
