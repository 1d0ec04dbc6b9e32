"""Top k documents by BM25 as joins on the query vocabulary, with score bounds.

For each term the index holds its highest frequency and the least length of a document that has it, from which
a term's share of a score can be bounded whatever the average length is now. A search then is

1. a threshold round: the few terms of highest bound per query are scored; the k-th best partial score is a
   threshold that every result must reach;
2. the terms of least bound that together stay below the threshold are left aside: a document that has no other
   term cannot reach it. Documents with another term get their partial score from these terms. For a query whose
   other terms may reach most documents the same pass adds up the terms left aside, too, beside the partial score;
3. only documents whose partial score and the bounds of the terms left aside reach the threshold (raised by the
   partial scores) are scored in full, if they are not yet, and the top k taken.

The forward index is dealt by document, so the scores of a document are added up where its postings lie: pairs of
a query and a document do not move, and only those that reach the threshold are kept. The result is exact,
because a bound is never below a score. This suits queries with rare terms; where every query shares a term with
most documents the bounds leave little out, and the scan (``glint.operators.scoring``) is the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glint.operators.text_index import K1, B, BM25Index, bounded_broadcast, postings_of, query_terms, top_by
from glint.session import written

LEADING = 4                 # terms of a query that set its first threshold
BROAD = 0.5                 # share of the documents from which on the terms left aside are added up at once
SLACK = 1e-8                # scores are ranked at 9 places


def impact(index: BM25Index, tf: str, dl: str) -> Column:
    """Score of a term per unit of query weight. Okapi scales tf by k1 + 1; the plus1 variant (second
    retriever, Lucene form) does not."""
    avgdl = index.avgdl if index.avgdl > 0 else 1.0
    scale = K1 + 1 if index.variant == "okapi" else 1.0
    return (F.col(tf) * F.lit(scale)
            / (F.col(tf) + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col(dl) / F.lit(avgdl))))


def query_weights(index: BM25Index, qterms: DataFrame) -> DataFrame:
    """``query_id, term, w, share, most, below``: query terms that the corpus knows, with count times idf, the share of
    the documents that have the term, the most that the term adds to a score (0 or more), and what all of the query's
    terms take away at most (0 or less)."""
    bound = F.col("w") * impact(index, "top_tf", "least_dl")
    w = qterms.join(index.terms.select("term", "df", "idf", "top_tf", "least_dl"), "term").withColumn(
        "w", F.col("qn") * F.col("idf"))
    return w.select("query_id", "term", "w", (F.col("df") / F.lit(float(index.n_docs))).alias("share"),
                    F.greatest(bound, F.lit(0.0)).alias("most"),
                    F.sum(F.least(bound, F.lit(0.0))).over(Window.partitionBy("query_id")).alias("below"))


def scores_of(index: BM25Index, weights: DataFrame, *more: str, by: list[Column] | None = None) -> DataFrame:
    """``query_id, doc_id, score``: sums over the terms in ``weights`` of the documents that have one of them. The rows
    of the forward index are dealt by document, and the sums need no second exchange. ``by``: other sums of a term's
    share ``_s``, with columns ``more`` of ``weights``."""
    wanted = bounded_broadcast(weights.select("query_id", "term", "w", *more))
    p = postings_of(index.forward.select("doc_id", "dl", "terms", "tfs").repartition("doc_id")).join(wanted, "term")
    p = p.withColumn("_s", F.col("w") * impact(index, "tf", "dl"))
    return p.groupBy("query_id", "doc_id").agg(*(by or [F.sum("_s").alias("score")]))


def thresholds(partial: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """``query_id, least``: a score that a query's top ``k`` reach for certain; no row for fewer documents."""
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    below = weights.groupBy("query_id").agg(F.first("below").alias("below"))
    kth = partial.withColumn("_n", F.row_number().over(by_score)).filter(F.col("_n") == k)
    kth = kth.join(below, "query_id").withColumn("least", F.col("score") + F.col("below"))
    return kth.select("query_id", (F.col("least") - F.greatest(F.abs("least"), F.lit(1.0)) * SLACK).alias("least"))


def split_terms(weights: DataFrame, first: DataFrame) -> DataFrame:
    """``weights`` with ``aside``: the terms of least bound whose bounds together stay below the query's threshold, and
    ``broad``: whether the query's other terms together may be in more than a share ``BROAD`` of the documents."""
    upto = F.sum("most").over(Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(
        Window.unboundedPreceding, Window.currentRow))
    w = weights.join(first, "query_id", "left").withColumn("aside", F.coalesce(upto < F.col("least"), F.lit(False)))
    reach = F.sum(F.when(F.col("aside"), 0.0).otherwise(F.col("share"))).over(Window.partitionBy("query_id"))
    return w.withColumn("broad", reach > BROAD).drop("least")


def partial_scores(index: BM25Index, weights: DataFrame) -> DataFrame:
    """``query_id, doc_id, score, more``: sums over the terms not left aside of the documents that have one of them, and
    over the terms left aside of broad queries."""
    wanted = weights.filter("broad OR NOT aside")
    late = F.col("aside") & F.col("doc_id").isNotNull()
    return scores_of(index, wanted, "aside", by=[
        F.sum(F.when(~F.col("aside"), F.col("_s"))).alias("score"),
        F.coalesce(F.sum(F.when(late, F.col("_s"))), F.lit(0.0)).alias("more")]).filter(F.col("score").isNotNull())


def reaching(partial: DataFrame, weights: DataFrame, least: DataFrame) -> DataFrame:
    """The rows of ``partial`` that with the bounds of the terms left aside reach the
    query's threshold in ``least``."""
    rest = weights.groupBy("query_id").agg(F.sum(F.when(F.col("aside"), F.col("most")).otherwise(0.0)).alias("rest"))
    j = partial.join(bounded_broadcast(rest.join(least, "query_id", "left")), "query_id")
    return j.filter(F.col("least").isNull() | (F.col("score") + F.col("rest") >= F.col("least"))).select(
        *partial.columns)


def survivors(partial: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """Of the documents with a partial score those that can be in the top ``k``."""
    return reaching(partial, weights, thresholds(partial, weights, k))


def completed(index: BM25Index, weights: DataFrame, left: DataFrame) -> DataFrame:
    """``query_id, doc_id, bm25``: the partial scores of ``left`` with the terms left aside added, those of broad queries
    from ``more``."""
    aside = bounded_broadcast(weights.filter("aside AND NOT broad").select("query_id", "term", "w"))
    narrow = weights.filter("NOT broad").select("query_id").distinct()
    mine = bounded_broadcast(left.select("query_id", "doc_id").join(bounded_broadcast(narrow), "query_id", "left_semi"))
    docs = index.forward.select("doc_id", "dl", "terms", "tfs").join(mine.select("doc_id").distinct(), "doc_id", "left_semi")
    p = postings_of(docs).join(aside, "term").join(mine, ["query_id", "doc_id"], "left_semi")
    part = p.select("query_id", "doc_id", (F.col("w") * impact(index, "tf", "dl")).alias("score"))
    known = left.select("query_id", "doc_id", (F.col("score") + F.col("more")).alias("score"))
    return known.unionByName(part).groupBy("query_id", "doc_id").agg(F.sum("score").alias("bm25"))


def bm25_join(index: BM25Index, queries: DataFrame, k: int = 10, query_text: str = "query",
              query_tokens: str | None = None, stems: bool = False) -> DataFrame:
    """``query_id, rank, doc_id, bm25``: the top ``k`` documents per query among those sharing a term.

    ``query_tokens`` names a column of processed tokens instead of the text; ``stems`` takes their stems.
    """
    weights = written(query_weights(index, query_terms(queries, text=query_text, tokens=query_tokens, stems=stems)),
                      "bm25-weights")
    lead = Window.partitionBy("query_id").orderBy(F.col("most").desc(), "term")
    leading = weights.withColumn("_n", F.row_number().over(lead)).filter(F.col("_n") <= LEADING)
    first = written(thresholds(scores_of(index, leading), weights, k), "bm25-least")
    weights = written(split_terms(weights, first), "bm25-weights")
    partial = written(reaching(partial_scores(index, weights), weights, first), "bm25-partial")
    scores = completed(index, weights, written(survivors(partial, weights, k), "bm25-left"))
    return top_by(scores, k, "bm25").select("query_id", "rank", "doc_id", "bm25")
