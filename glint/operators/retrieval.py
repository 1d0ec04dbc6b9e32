"""Hybrid keyword + vector retrieval for many queries in one job (J2, A5, V6, T2, F6, T3, F7, F8),
and the contextual two-retriever fusion (J1, A6, T5).

Combined score per (query, doc): ``0.4 * bm25 / max_bm25 + 0.6 * sem / max_sem``
(each term 0 when its maximum is not above 0), top ``k`` by it (ties by doc id),
then kept when ``>= min_relevance``; optionally re-ranked by a second score.

Exact without scoring all pairs as rows: blocks of queries are broadcast and the forward index is
scanned twice, for the maxima and for the top k by the combined score (``glint.operators.scoring``).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glint.functions.text import tokenize, truncate_tokens
from glint.functions.vector import cosine
from glint.operators.models import embed
from glint.operators.scoring import bm25_topk, hybrid_topk
from glint.operators.text_index import BM25Index, bounded_broadcast, top_by
from glint.operators.vectors import top_k
from glint.session import written

W_BM25 = 0.4
W_SEM = 0.6
HIGH_RELEVANCE = 0.7


def _norm(score: str, mx: str):
    return F.when(F.col(mx) > 0, F.col(score) / F.col(mx)).otherwise(F.lit(0.0))


def hybrid_scores(index: BM25Index, docs: DataFrame | None, queries: DataFrame, k: int = 5,
                  min_relevance: float = 0.5, w_bm25: float = W_BM25, w_sem: float = W_SEM,
                  start=None, end=None, query_text: str = "query") -> DataFrame:
    """``query_id, rank, doc_id, relevance_score, bm25, semantic`` after top-k and threshold.

    ``docs``: ``doc_id, embedding[, timestamp]``, or None when the index carries them; ``queries``:
    ``query_id, <query_text>, embedding``. ``start``/``end`` keep documents whose timestamp is in the
    window (F8; columns ``start``/``end`` of ``queries`` set one for each query); the index statistics
    stay those of the whole corpus.
    """
    return hybrid_topk(index, docs, queries, k, min_relevance, w_bm25, w_sem, start, end, query_text)


def rerank(hits: DataFrame, doc_vecs: DataFrame, query_vecs: DataFrame) -> DataFrame:
    """Score only the kept rows with a second encoder (cosine; missing vector -> 0.0)
    and re-sort; adds ``reranking_score`` and ``rerank_rank``."""
    j = (hits.join(doc_vecs.select("doc_id", F.col("embedding").alias("_dv")), "doc_id", "left")
         .join(query_vecs.select("query_id", F.col("embedding").alias("_qv")), "query_id", "left"))
    j = j.withColumn("reranking_score", F.when(F.col("_dv").isNull() | F.col("_qv").isNull(), F.lit(0.0))
                     .otherwise(cosine("_qv", "_dv"))).drop("_dv", "_qv")
    w = Window.partitionBy("query_id").orderBy(F.round("reranking_score", 9).desc(), F.col("rank"))
    return j.withColumn("rerank_rank", F.row_number().over(w))


def encoded(texts: DataFrame, encoder, dim: int, cache: str | None = None) -> DataFrame:
    """``sha, vector`` of the distinct ``sha, text`` rows. With ``cache``, a folder of vectors by content hash, only texts
    that it does not hold reach the encoder, and theirs are added to it."""
    spark = texts.sparkSession
    new, known = texts, None
    if cache is not None:
        try:
            known = spark.read.parquet(cache)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        if known is not None:
            new = texts.join(known.select("sha"), "sha", "left_anti")
    made = embed(new, "text", encoder, dim, "vector").select("sha", F.col("vector").cast("array<double>").alias("vector"))
    if cache is None:
        return made
    made.write.mode("append").parquet(cache)
    return spark.read.parquet(cache).join(texts.select("sha"), "sha", "left_semi").dropDuplicates(["sha"])


def rerank_by_encoder(hits: DataFrame, docs: DataFrame, queries: DataFrame, encoder=None, dim: int = 64,
                      cache: str | None = None, max_tokens: int = 512, query_text: str = "query") -> DataFrame:
    """T3 + V9: kept rows scored by a second encoder and re-sorted; adds ``reranking_score`` and ``rerank_rank``.

    Two stages: only the texts of the hits (``docs``: ``doc_id, content``) and of their queries, cut to ``max_tokens``
    tokens, reach ``encoder`` (texts -> vectors of ``dim``; without one, feature hashing), each distinct text once.
    """
    def cut(text: str):
        return F.array_join(truncate_tokens(tokenize(text), max_tokens), " ").alias("text")
    hits = written(hits, "rerank-hits")             # named three times: the search behind it runs once
    d = docs.join(bounded_broadcast(hits.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", cut("content"))
    q = queries.join(hits.select("query_id").distinct(), "query_id", "left_semi").select("query_id", cut(query_text))
    d, q = (x.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("sha", F.sha2("text", 256)) for x in (d, q))
    d, q = written(d, "rerank-docs"), written(q, "rerank-queries")
    texts = d.select("sha", "text").unionByName(q.select("sha", "text")).dropDuplicates(["sha"])
    vectors = encoded(texts, encoder, dim, cache)
    dv = d.join(vectors, "sha").select("doc_id", F.col("vector").alias("embedding"))
    qv = q.join(vectors, "sha").select("query_id", F.col("vector").alias("embedding"))
    return rerank(hits, dv, qv)


def high_relevance(hits: DataFrame, bound: float = HIGH_RELEVANCE) -> DataFrame:
    """relevance or rerank score at least ``bound``; missing scores count as 0."""
    return hits.filter((F.coalesce("relevance_score", F.lit(0.0)) >= bound)
                       | (F.coalesce("reranking_score", F.lit(0.0)) >= bound))


def fuse_nodes(vector_hits: DataFrame, bm25_hits: DataFrame, wv: float = 0.7, wb: float = 0.3,
               k: int = 3) -> DataFrame:
    """Full outer merge on (query_id, node_id); a node found by both gets
    ``wv * v + wb * b``, a node found by one keeps its raw score; top ``k``."""
    v = vector_hits.select("query_id", "node_id", F.col("score").alias("v"))
    b = bm25_hits.select("query_id", "node_id", F.col("score").alias("b"))
    j = v.join(b, ["query_id", "node_id"], "full")
    j = j.withColumn("score", F.when(F.col("v").isNotNull() & F.col("b").isNotNull(),
                                     F.lit(wv) * F.col("v") + F.lit(wb) * F.col("b"))
                     .otherwise(F.coalesce("v", "b")))
    return top_by(j, k, "score", tie="node_id").select("query_id", "rank", "node_id", "score",
                                                      F.col("v").alias("vector_score"),
                                                      F.col("b").alias("bm25_score"))


def contextual_retrieve(index: BM25Index, docs: DataFrame, queries: DataFrame, k: int = 3,
                        query_tokens: str = "tokens", stems: bool = False) -> DataFrame:
    """T5: the vector retriever's top ``k`` (cosine) and the BM25 retriever's top ``k``
    (``index`` built on the same token processing as ``query_tokens`` and ``stems``), fused by
    ``fuse_nodes`` and cut to ``k`` again."""
    v = top_k(docs, queries, k, "cosine", item_id="doc_id")
    v = v.select("query_id", F.col("item_id").alias("node_id"), "score")
    b = bm25_topk(index, queries, k, query_tokens=query_tokens, stems=stems) \
        .select("query_id", F.col("doc_id").alias("node_id"), F.col("bm25").alias("score"))
    return fuse_nodes(v, b, 0.7, 0.3, k)
