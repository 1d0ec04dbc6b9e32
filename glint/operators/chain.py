"""The analysis chain of every symbol in one job: retrieval, memories, research, context, decision, stored memory.

Each step is a DataFrame over all symbols; what a step finds is reduced to one row per symbol before it is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glint.functions.text import enhance_query
from glint.operators import assemble as A
from glint.operators import retrieval as R
from glint.operators.memory import search_memories
from glint.operators.models import append_memories
from glint.operators.text_index import BM25Index, bounded_broadcast
from glint.session import written

MEMORY_TYPE = "trading_decision"
MIN_IMPORTANCE = 0.6


def _now(now) -> Column:
    return F.lit(now).cast("timestamp_ntz") if isinstance(now, str) else now


def retrieval_queries(symbols: DataFrame, now) -> DataFrame:
    """``query_id, symbol, query, embedding`` of ``symbols`` (``symbol, symbol_id, embedding``): the retrieval text of a
    symbol within its market context (V18)."""
    text = F.concat(F.lit("Recent trading patterns and market context for "), "symbol")
    return symbols.select(F.col("symbol_id").alias("query_id"), "symbol", "embedding",
                          enhance_query(text, F.col("symbol"), _now(now)).alias("query"))


def insights(index: BM25Index, docs: DataFrame, queries: DataFrame, encoder=None, dim: int = 64, k: int = 5,
             cache: str | None = None) -> DataFrame:
    """``symbol, insights_text``: hybrid hits of each symbol's query, re-ranked by the encoder, highly relevant ones only."""
    hits = R.hybrid_scores(index, None, queries, k)
    kept = R.high_relevance(R.rerank_by_encoder(hits, docs, queries, encoder, dim, cache))
    kept = written(kept, "chain-hits")
    texts = docs.join(bounded_broadcast(kept.select("doc_id").distinct()), "doc_id", "left_semi").select(
        "doc_id", F.substring("content", 1, A.HIT_CHARS).alias("content"))      # what is shown of a hit, however long its text is
    rows = kept.join(texts, "doc_id").join(queries.select("query_id", "symbol"), "query_id")
    return A.hits_text(rows.withColumn("rank", F.col("rerank_rank")))


def remembered(memories: DataFrame, symbols: DataFrame, limit: int = 5) -> DataFrame:
    """``symbol, memories_text``: the nearest past decisions of each symbol's vector with importance >= 0.6."""
    q = symbols.select(F.col("symbol_id").alias("query_id"), "symbol", "embedding")
    hits = search_memories(memories, q, limit, "l2sq", memory_type=MEMORY_TYPE, min_importance=MIN_IMPORTANCE)
    record = F.get_json_object("content", "$.decision.recommendation")
    found = (hits.join(memories.select("memory_id", "content", "timestamp", "importance"), "memory_id")
             .join(q.select("query_id", "symbol"), "query_id"))
    line = A.format_memory(F.col("timestamp"), F.get_json_object("content", "$.symbol"), record, F.col("importance"))
    return found.groupBy("symbol").agg(A.collect_text(line, F.col("rank"), F.col("memory_id")).alias("memories_text"))


def analyse(context: DataFrame, research: DataFrame, memories: DataFrame, hits: DataFrame, now,
            decide_fn=None, sentiment_fn=None) -> DataFrame:
    """One row per symbol with the analysis text and the decision (see ``assemble.decide``)."""
    a = A.analysis_text(A.assemble_analysis(context, research, memories, hits), _now(now))
    return A.decide(a, decide_fn, sentiment_fn)


def decision_records(decided: DataFrame, now) -> DataFrame:
    """Decisions as memories: content and context are JSON, the sentiment is kept as emotions."""
    decision = F.struct("recommendation", "confidence", "sentiment")
    content = F.to_json(F.struct("symbol", F.col("analysis_text").alias("analysis"), decision.alias("decision"),
                                 F.col("insights_text").alias("rag_insights")))
    market = F.struct("trend_strength", "volatility_level", "volume_signal", "price_momentum")
    indicators = F.struct("close", "sma_20", "sma_50", "z_score", "volume_ratio", "trend")
    return decided.select(
        F.lit(MEMORY_TYPE).alias("memory_type"), content.alias("content"), _now(now).alias("timestamp"),
        F.lit(1.0).alias("importance"),
        F.create_map(F.lit("symbol"), F.col("symbol"), F.lit("action"), F.col("recommendation")).alias("metadata"),
        F.to_json(F.struct(market.alias("market_conditions"), indicators.alias("technical_indicators"))).alias("context"),
        F.col("sentiment").alias("emotions"))


def run_chain(context: DataFrame, research: DataFrame, memories: DataFrame, hits: DataFrame, now, path: str,
              decide_fn=None, sentiment_fn=None, scorer=None, embedder=None) -> DataFrame:
    """Analyse every symbol, store the decisions in the memory table at ``path`` (a replay stores nothing twice), and
    return the decided rows."""
    decided = written(analyse(context, research, memories, hits, now, decide_fn, sentiment_fn), "chain-decisions")
    append_memories(decision_records(decided, now), path, scorer, embedder)
    return decided


def latest_decisions(memories: DataFrame) -> DataFrame:
    """``symbol, timestamp, action, importance, id`` of the newest stored decision of each symbol."""
    m = memories.filter(F.col("memory_type") == MEMORY_TYPE).withColumn("symbol", F.col("metadata")["symbol"])
    w = Window.partitionBy("symbol").orderBy(F.col("timestamp").desc(), F.col("id"))
    return (m.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == 1)
            .select("symbol", "timestamp", F.col("metadata")["action"].alias("action"), "importance", "id"))
