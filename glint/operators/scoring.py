"""Keyword and hybrid scores by scans of the forward index.

Queries are dealt into blocks of a bounded size, in the order of their time windows; a block (weighted
terms and vectors) is broadcast. Documents are never shuffled: a scan of the forward index, cut to the
columns it needs and to the time span of the block's windows, scores its rows against the block
in Arrow batches and keeps a few rows per query and task. Two scans per block:

* maxima of both scores per query, over the documents of the query's window;
* the task's top k by ``w_bm25 * bm25 / max_bm25 + w_sem * sem / max_sem``.

A global ``row_number`` over the emitted rows gives the exact answer. Many queries that have most of their terms in
common are not dealt into such blocks but scored together (``glint.operators.alike``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glint.functions.scalar import ntz_micros
from glint.operators.alike import AlikeQueries, Asked, alike_queries, alike_topk
from glint.operators.text_index import K1, RANK_PLACES, B, BM25Index, query_terms, top_by
from glint.operators.vectors import arrow_batches, best, lists_of, matrix
from glint.session import written

QUERIES_PER_BLOCK = 2048
PAIRS_PER_BLOCK = 1 << 20       # (query, term) pairs of a block
BLOCK_BYTES = 1 << 30           # the vectors of a block are bounded by its queries
QUERIES_TOGETHER = 1 << 17      # queries that are compared for being alike, and scored at once if they are
PAIRS_TOGETHER = 1 << 22
BYTES_TOGETHER = 128 << 20
EXPAND_LIMIT = 4_000_000        # (posting, query) pairs expanded at once
OFTEN = 8                       # queries of a block (or a sixteenth of them) that make a term a row of the matrix product
TERMS_AT_ONCE = 512             # rows of that product at once
CELLS_AT_ONCE = 1 << 20         # (query, document) scores at once
ROWS_AT_ONCE = 4096             # documents scored at once

SCORES = "query_id long, doc_id long, bm25 double, semantic double, relevance_score double"
MAXIMA = "query_id long, max_bm25 double, max_sem double"
TOP_BM25 = "query_id long, doc_id long, bm25 double"


@dataclass
class QueryBlock:
    """Queries that a scan serves: ids, vectors, windows (micros, NaN: open), and query terms by code."""

    ids: np.ndarray
    vectors: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    vocabulary: np.ndarray
    first: np.ndarray            # where the (query, weight) pairs of each term begin, and the end
    query: np.ndarray
    weight: np.ndarray
    avgdl: float
    scale: float

    def bm25(self, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all (query, document), and how many terms they share. Terms that many queries of the block ask for
        are one matrix product; each other posting goes to the queries that share its term."""
        nq, nd = len(self.ids), len(rows)
        doc = np.repeat(np.arange(nd), rows["codes"].map(len).to_numpy(dtype=np.int64))
        code = np.concatenate([*rows["codes"], np.array([], np.int64)]).astype(np.int64)
        tf = np.concatenate([*rows["tfs"], np.array([], np.int64)]).astype(float)
        length = rows["dl"].to_numpy(dtype=float)[doc]
        part = tf * self.scale / (tf + K1 * (1 - B + B * length / self.avgdl))
        out, shared = np.zeros((nq, nd)), np.zeros((nq, nd))
        asked = self.first[1:] - self.first[:-1]
        often = np.flatnonzero(asked >= max(OFTEN, nq // 16))
        for lo in range(0, len(often), TERMS_AT_ONCE):
            some = often[lo:lo + TERMS_AT_ONCE]
            place = np.full(len(asked), -1)
            place[some] = np.arange(len(some))
            weight, has = np.zeros((nq, len(some))), np.zeros((nq, len(some)))
            for i, t in enumerate(some.tolist()):
                pairs = slice(self.first[t], self.first[t + 1])
                weight[self.query[pairs], i], has[self.query[pairs], i] = self.weight[pairs], 1.0
            at = place[code] >= 0
            parts, found = np.zeros((len(some), nd)), np.zeros((len(some), nd))
            parts[place[code[at]], doc[at]], found[place[code[at]], doc[at]] = part[at], 1.0
            out += weight @ parts
            shared += has @ found
        rare = asked[code] < max(OFTEN, nq // 16)
        code, doc, part = code[rare], doc[rare], part[rare]
        size = asked[code]
        upto = np.append(0, np.cumsum(size))
        lo = 0
        while lo < len(code):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + EXPAND_LIMIT, side="right")) - 1)
            n = size[lo:hi]
            pair = np.repeat(self.first[code[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            posting = np.repeat(np.arange(lo, hi), n)
            np.add.at(out, (self.query[pair], doc[posting]), self.weight[pair] * part[posting])
            np.add.at(shared, (self.query[pair], doc[posting]), 1.0)
            lo = hi
        return out, shared

    def inside(self, micros: np.ndarray) -> np.ndarray:
        """Which documents lie in which query's window; an open side admits all, a document without time none."""
        t = micros.astype(float)[None, :]
        with np.errstate(invalid="ignore"):
            return ((np.isnan(self.starts)[:, None] | (t >= self.starts[:, None]))
                    & (np.isnan(self.ends)[:, None] | (t <= self.ends[:, None])))

    def slices(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The scanned rows, few enough at once that a matrix of all (query, document) stays small."""
        n = max(1, min(ROWS_AT_ONCE, CELLS_AT_ONCE // max(len(self.ids), 1)))
        for pdf in batches:
            for at in range(0, len(pdf), n):
                yield pdf.iloc[at:at + n]

    def scored(self, batches: Iterator[pd.DataFrame]):
        """(documents, bm25, semantic, inside) of slices of the scanned rows."""
        for rows in self.slices(batches):
            sem = self.vectors @ matrix(rows["embedding"], self.vectors.shape[1]).T
            yield rows["doc_id"].to_numpy(), self.bm25(rows)[0], sem, self.inside(rows["_t"].to_numpy(dtype=float))


def coded(rows: DataFrame, vocabulary) -> DataFrame:
    """``rows`` with the postings of the (broadcast) ``vocabulary`` only, terms as their places in it (``codes``). Texts stay
    in Arrow buffers, so a worker holds no object per posting."""
    schema = T.StructType([T.StructField("codes", T.ArrayType(T.IntegerType()), False) if f.name == "terms" else f
                           for f in rows.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                terms = part.column("terms")
                words = terms.flatten()
                doc = np.repeat(np.arange(len(terms)), pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False))
                code = pc.index_in(words, value_set=pa.array(vocabulary.value, type=words.type))
                ends = np.cumsum(np.bincount(doc[pc.is_valid(code).to_numpy(zero_copy_only=False)], minlength=len(terms)))
                ends = pa.array(np.append(0, ends), type=pa.int32())
                made = {"terms": pa.ListArray.from_arrays(ends, code.drop_null()),
                        "tfs": pa.ListArray.from_arrays(ends, part.column("tfs").flatten().filter(pc.is_valid(code)))}
                yield pa.RecordBatch.from_arrays([made.get(n, part.column(n)) for n in part.schema.names], names=schema.names)
    return rows.mapInArrow(run, schema)


def gathered(index: BM25Index, queries: DataFrame, qterms: DataFrame, most: int, pairs: int,
             size: int) -> Iterator[tuple[list[Asked], list[str], list[int]]]:
    """Queries in the order of their windows, at most ``most``, ``pairs`` terms and ``size`` bytes at once, with the
    terms of their codes and the number of documents that have each. They reach the driver in compact form."""
    w = qterms.join(index.terms.select("term", "idf", "df"), "term").groupBy("query_id").agg(F.collect_list(
        F.struct("term", (F.col("qn") * F.col("idf")).alias("w"), "df")).alias("_terms"))
    micros = lambda c: (ntz_micros(c) if c in queries.columns else F.lit(None).cast("long")).alias(f"_{c}")
    vec = F.col("embedding") if "embedding" in queries.columns else F.lit(None)
    q = queries.select("query_id", vec.cast("array<double>").alias("embedding"), micros("start"), micros("end")).join(w, "query_id", "left").orderBy("_start", "_end", "query_id")
    asked: list[Asked] = []
    code: dict[str, int] = {}
    df: list[int] = []
    held = taken = 0
    q = q.select("query_id", "embedding", "_start", "_end", "_terms.term", "_terms.w", "_terms.df")
    for batch in arrow_batches(q):
        column = {n: batch.column(n) for n in batch.schema.names}
        number = [column[n].cast(pa.float64()).to_numpy(zero_copy_only=False) for n in ("_start", "_end")]     # NULL: NaN
        words = column["term"].values.dictionary_encode()       # a text per distinct term
        known, word, at = words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False), column["term"].offsets.to_numpy()
        weight, docs = (column[n].values.to_numpy(zero_copy_only=False) for n in ("w", "df"))
        for i, (query, vector) in enumerate(zip(column["query_id"].to_pylist(), lists_of(column["embedding"]), strict=True)):
            here = slice(at[i], at[i + 1])
            codes = []
            for t, n in zip(word[here].tolist(), docs[here].tolist(), strict=True):
                codes.append(code.setdefault(known[t], len(df)))
                if codes[-1] == len(df):
                    df.append(n)
            asked.append(Asked(query, vector, number[0][i], number[1][i], np.array(codes, dtype=np.int64), weight[here]))
            held, taken = held + len(codes), taken + 16 * len(codes) + (0 if vector is None else vector.nbytes)
            if len(asked) == most or held >= pairs or taken >= size:
                yield asked, list(code), df
                asked, code, df, held, taken = [], {}, [], 0, 0
    if asked:
        yield asked, list(code), df


def block_of(index: BM25Index, asked: list[Asked], terms: list[str]) -> QueryBlock:
    pairs = pd.DataFrame({"term": [terms[c] for a in asked for c in a.codes.tolist()],
                          "query": np.repeat(np.arange(len(asked)), [len(a.codes) for a in asked]),
                          "weight": np.concatenate([a.weights for a in asked])}).sort_values("term", kind="stable")
    first = np.append(0, np.cumsum(pairs.groupby("term", sort=False).size().to_numpy(dtype=np.int64)))
    dim = max((len(a.vector) for a in asked if a.vector is not None), default=0)
    return QueryBlock(np.array([a.query_id for a in asked], dtype=np.int64),
                      matrix(pd.Series([a.vector for a in asked], dtype=object), dim), np.array([a.start for a in asked]),
                      np.array([a.end for a in asked]), pairs["term"].unique().astype(object), first,
                      pairs["query"].to_numpy(dtype=np.int64), pairs["weight"].to_numpy(dtype=float), _avgdl(index), _scale(index))


def _avgdl(index: BM25Index) -> float:
    return index.avgdl if index.avgdl > 0 else 1.0


def _scale(index: BM25Index) -> float:
    return K1 + 1 if index.variant == "okapi" else 1.0


def query_blocks(index: BM25Index, queries: DataFrame, qterms: DataFrame) -> Iterator[QueryBlock]:
    """Blocks of at most ``QUERIES_PER_BLOCK`` queries in the order of their windows.

    A block reaches the driver and is broadcast: its queries' vectors and terms bound its size.
    """
    for asked, terms, _ in gathered(index, queries, qterms, QUERIES_PER_BLOCK, PAIRS_PER_BLOCK, BLOCK_BYTES):
        yield block_of(index, asked, terms)


def alike_or_blocks(index: BM25Index, queries: DataFrame, qterms: DataFrame) -> Iterator[tuple[AlikeQueries | QueryBlock, np.ndarray]]:
    """The queries with their vocabulary: many at once where they are alike (``glint.operators.alike``), else blocks."""
    for asked, terms, df in gathered(index, queries, qterms, QUERIES_TOGETHER, PAIRS_TOGETHER, BYTES_TOGETHER):
        alike = alike_queries(asked, df, index.n_docs, _avgdl(index), _scale(index))
        if alike is not None:
            yield alike, np.array(terms, dtype=object)
            continue
        lo = held = 0
        for i, a in enumerate(asked, 1):
            held += len(a.codes)
            if i - lo == QUERIES_PER_BLOCK or held >= PAIRS_PER_BLOCK or i == len(asked):
                block = block_of(index, asked[lo:i], terms)
                yield block, block.vocabulary
                lo, held = i, 0


def documents_between(docs: DataFrame, start: float, end: float) -> DataFrame:
    """Rows whose ``timestamp`` can lie in a window; the bounds are plain literals, so they reach the scan."""
    for bound, op in ((start, "__ge__"), (end, "__le__")):
        if not np.isnan(bound):
            at = np.datetime64(int(bound), "us").item()
            docs = docs.filter(getattr(F.col("timestamp"), op)(F.lit(at).cast("timestamp_ntz")))
    return docs


def _maxima(held):
    def run(batches):
        block = held.value
        best = np.full((2, len(block.ids)), -np.inf)
        for _, bm, sem, inside in block.scored(batches):
            for i, s in enumerate((bm, sem)):
                best[i] = np.maximum(best[i], np.where(inside, s, -np.inf).max(axis=1, initial=-np.inf))
        seen = best[0] > -np.inf
        yield pd.DataFrame({"query_id": block.ids[seen], "max_bm25": best[0][seen], "max_sem": best[1][seen]})
    return run


def _top(held, k: int, w_bm25: float, w_sem: float):
    def run(batches):
        block, most = held.value                            # maxima per query; not above 0: the score counts as 0
        kept: dict[int, list[np.ndarray]] = {}              # per query: ids, bm25, semantic, combined
        least = np.full(len(block.ids), np.inf)             # the key of a query's k-th best so far
        for ids, bm, sem, inside in block.scored(batches):
            share = [np.where(m > 0, s / np.where(m > 0, m, 1.0), 0.0)
                     for s, m in ((bm, most[0][:, None]), (sem, most[1][:, None]))]
            score = w_bm25 * share[0] + w_sem * share[1]
            able = inside & ~(np.round(-score, RANK_PLACES) > least[:, None])
            for q in np.flatnonzero(able.any(axis=1)).tolist():
                at = np.flatnonzero(able[q])
                if len(at):
                    at = at[best(np.round(-score[q, at], RANK_PLACES), ids[at], k)]
                    new = [ids[at], bm[q, at], sem[q, at], score[q, at]]
                    if q in kept:
                        new = [np.append(x, y) for x, y in zip(kept[q], new, strict=True)]
                        at = best(np.round(-new[3], RANK_PLACES), new[0], k)
                        new = [x[at] for x in new]
                    kept[q] = new
                    if len(new[0]) == k:
                        least[q] = np.round(-new[3][-1], RANK_PLACES)
        if kept:
            n = [len(x[0]) for x in kept.values()]
            cols = [np.concatenate(c) for c in zip(*kept.values(), strict=True)]
            yield pd.DataFrame(dict(zip([f.split()[0] for f in SCORES.split(", ")],
                                        [np.repeat(block.ids[list(kept)], n), *cols], strict=True)))
    return run


def _top_bm25(held, k: int):
    def run(batches):
        block = held.value
        kept: dict[int, list[np.ndarray]] = {}              # per query: ids, scores
        least = np.full(len(block.ids), np.inf)             # the key of a query's k-th best so far
        for rows in block.slices(batches):
            ids = rows["doc_id"].to_numpy()
            scores, shared = block.bm25(rows)
            able = (shared > 0) & ~(np.round(-scores, RANK_PLACES) > least[:, None])
            for q in np.flatnonzero(able.any(axis=1)).tolist():
                found = np.flatnonzero(able[q])
                if len(found):
                    found = found[best(np.round(-scores[q, found], RANK_PLACES), ids[found], k)]
                    new = [ids[found], scores[q, found]]
                    if q in kept:
                        new = [np.append(x, y) for x, y in zip(kept[q], new, strict=True)]
                        top = best(np.round(-new[1], RANK_PLACES), new[0], k)
                        new = [x[top] for x in new]
                    kept[q] = new
                    if len(new[0]) == k:
                        least[q] = np.round(-new[1][-1], RANK_PLACES)
        if kept:
            n = [len(i) for i, _ in kept.values()]
            ids, scores = (np.concatenate(c) for c in zip(*kept.values(), strict=True))
            yield pd.DataFrame({"query_id": np.repeat(block.ids[list(kept)], n), "doc_id": ids, "bm25": scores})
    return run


def bm25_topk(index: BM25Index, queries: DataFrame, k: int = 10, query_text: str = "query",
              query_tokens: str | None = None, stems: bool = False) -> DataFrame:
    """``query_id, rank, doc_id, bm25``: the top ``k`` documents per query among those sharing a term (J4, V7), by a scan.

    ``query_tokens`` names a column of processed tokens instead of the text; ``stems`` takes their stems. Where the
    queries' terms are rare, ``glint.operators.bm25.bm25_join`` moves their postings only and scans nothing else.
    """
    rows = index.forward.select("doc_id", "dl", "terms", "tfs")
    send, found = rows.sparkSession.sparkContext.broadcast, []
    qterms = query_terms(queries, text=query_text, tokens=query_tokens, stems=stems)
    for block in query_blocks(index, queries.drop("start", "end"), qterms):
        found.append(coded(rows, send(block.vocabulary)).mapInPandas(_top_bm25(send(block), k), TOP_BM25))
    if not found:
        found = [rows.sparkSession.createDataFrame([], TOP_BM25)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return top_by(out, k, "bm25").select("query_id", "rank", "doc_id", "bm25")


def hybrid_topk(index: BM25Index, docs: DataFrame | None, queries: DataFrame, k: int = 5,
                min_relevance: float = 0.5, w_bm25: float = 0.4, w_sem: float = 0.6,
                start=None, end=None, query_text: str = "query") -> DataFrame:
    """Hybrid retrieval, exact. ``docs``: ``doc_id, embedding[, timestamp]``, joined to the index by id; None when
    the index carries these columns itself.

    ``start``/``end`` restrict all queries to one window; columns ``start``/``end`` on
    ``queries`` give each query its own window (maxima and top k within it)."""
    rows = index.forward if docs is None else docs.select("doc_id", *[c for c in ("embedding", "timestamp") if c in docs.columns]) \
        .join(index.forward.select("doc_id", "dl", "terms", "tfs"), "doc_id")
    for name, given in (("start", start), ("end", end)):
        if given is not None:
            queries = queries.withColumn(name, F.lit(given).cast("timestamp_ntz"))
    timed = "timestamp" in rows.columns
    found, send = [], rows.sparkSession.sparkContext.broadcast
    for block, vocabulary in alike_or_blocks(index, queries, query_terms(queries, text=query_text)):
        part = documents_between(rows, block.starts.min(), block.ends.max()) if timed else rows   # NaN: an open side
        part = part.select("doc_id", "dl", "terms", "tfs", F.col("embedding").cast("array<double>").alias("embedding"),
                           (ntz_micros("timestamp") if timed else F.lit(None).cast("long")).alias("_t"))
        part = coded(part, send(vocabulary))
        if isinstance(block, AlikeQueries):
            part = written(part, "hybrid-documents")        # scanned twice: the forward index is read once
            found.append(alike_topk(part, block, k, min_relevance, w_bm25, w_sem, SCORES))
            continue
        mx = part.mapInPandas(_maxima(send(block)), MAXIMA).groupBy("query_id").agg(
            F.max("max_bm25").alias("b"), F.max("max_sem").alias("s")).collect()       # a row per query of the block
        at = {q: i for i, q in enumerate(block.ids.tolist())}
        maxima = np.full((2, len(at)), -1.0)
        for r in mx:
            maxima[:, at[r["query_id"]]] = r["b"], r["s"]
        found.append(part.mapInPandas(_top(send((block, maxima)), k, w_bm25, w_sem), SCORES))
    if not found:
        found = [rows.sparkSession.createDataFrame([], SCORES)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return (top_by(out, k, "relevance_score").filter(F.col("relevance_score") >= F.lit(min_relevance))
            .select("query_id", "rank", "doc_id", "relevance_score", "bm25", "semantic"))
