"""The whole analysis of every symbol as one query."""

from __future__ import annotations

from pyspark.sql import functions as F

from glint.operators import assemble as A
from glint.operators import chain as C
from glint.operators import research as RS
from glint.operators import signals
from glint.plans import bindings as B
from glint.plans import q_assemble as QA
from glint.plans import q_retrieval as Q
from glint.plans import sqlbind as S
from glint.plans.catalog import register
from glint.plans.standins import letter_counts, plain_decision, plain_sentiment
from glint.session import shared_dir, written
from glint.sources.memories import read_memories


def _symbols(spark, sf):
    """Symbols with a number and a query vector (the embedding of that number)."""
    ctx = B.bars(spark, sf, "user_id").select("symbol").distinct().withColumn("symbol_id", F.col("symbol").cast("long"))
    v = B.vectors(spark, sf).withColumnRenamed("vec_id", "symbol_id")
    return ctx.join(v, "symbol_id", "left")


CHAIN_QUERIES = f"""queries AS (
  SELECT u.symbol_id AS query_id, CAST(u.symbol_id AS VARCHAR) AS symbol, v.embedding::DOUBLE[] AS embedding,
         'Context: Market Context: - Current Time: ' || strftime(TIMESTAMP '{B.NOW}', '%Y-%m-%d %H:%M:%S')
         || ' - Trading Session: ' || CASE WHEN hour(TIMESTAMP '{B.NOW}') BETWEEN 9 AND 16
                                          THEN 'Normal Trading Hours' ELSE 'Extended Hours' END
         || chr(10) || 'Symbol: ' || u.symbol_id || chr(10)
         || 'Query: Recent trading patterns and market context for ' || u.symbol_id AS query
  FROM (SELECT DISTINCT user_id AS symbol_id FROM events) u LEFT JOIN embeddings v ON v.vec_id = u.symbol_id)"""

INSIGHT_SQL = """chr(10) || 'Insight:' || chr(10) || left(content, 300) || '...' || chr(10) || 'Relevance: '
  || printf('%.2f', relevance_score) || chr(10) || 'Reranking Score: ' || printf('%.2f', reranking_score) || chr(10)"""


def chain_sql() -> str:
    head, tail = QA.ANALYSIS_SQL.split("mem AS (SELECT event_id AS memory_id")
    tail = "a AS (SELECT ctx.*" + tail.split("a AS (SELECT ctx.*", 1)[1]
    tail = tail.replace("coalesce(mt.memories_text, '') AS memories_text",
                        "coalesce(mt.memories_text, '') AS memories_text, coalesce(hi.insights_text, "
                        "'No highly relevant historical insights found.') AS insights_text")
    tail = tail.replace("LEFT JOIN mt USING (symbol))", "LEFT JOIN mt USING (symbol) LEFT JOIN hi USING (symbol))")
    tail = tail.replace("'No highly relevant historical insights found.'\n  ||", "insights_text\n  ||")
    tail = tail[:tail.rindex("SELECT symbol, trend")]
    qt = Q.QT_PLAIN.replace("SELECT item_id AS query_id", "SELECT query_id").replace(
        S.tokens("text"), S.tokens("query")).replace("FROM benchmark", "FROM queries")
    return f"""{head}
{S.DOCUMENTS}, {CHAIN_QUERIES}, {Q.BM25_CORE}, {qt}, {Q.bm25_sql('qt')}
{Q.HYBRID_TAIL.format(where='')}, {Q.encoder_sql('hits')},
good AS (SELECT rr.*, docs.content, queries.symbol,
                row_number() OVER (PARTITION BY query_id ORDER BY round(reranking_score, 9) DESC, rank) AS rerank_rank
         FROM rr JOIN docs USING (doc_id) JOIN queries USING (query_id)),
hi AS (SELECT symbol, string_agg({INSIGHT_SQL}, chr(10) ORDER BY rerank_rank, doc_id) AS insights_text
       FROM good WHERE relevance_score >= 0.7 OR reranking_score >= 0.7 GROUP BY symbol),
past AS (SELECT e.event_id AS memory_id, CAST(e.user_id AS VARCHAR) AS whose, e.ts, least(1.0, e.value / 100) AS importance,
                CASE WHEN e.value > 50 THEN 'BUY' ELSE 'SELL' END || ' ' || e.props AS rec, v.embedding::DOUBLE[] AS vec
         FROM events e JOIN embeddings v ON v.vec_id = e.event_id
         WHERE e.event_type = 'purchase' AND least(1.0, e.value / 100) >= 0.6),
near AS (SELECT q.symbol, p.*, row_number() OVER (PARTITION BY q.symbol ORDER BY round(list_sum(list_transform(
             list_zip(coalesce(q.embedding, list_transform(p.vec, lambda x: 0.0::DOUBLE)), p.vec),
             lambda t: (t[1] - t[2]) * (t[1] - t[2]))), 9), p.memory_id) AS rank
         FROM queries q CROSS JOIN past p QUALIFY rank <= 5),
mt AS (SELECT symbol, string_agg(chr(10) || 'Previous Analysis (' || strftime(ts, '%Y-%m-%d %H:%M') || '):'
                                 || chr(10) || 'Symbol: ' || whose || chr(10) || 'Decision: ' || left(rec, 200) || '...'
                                 || chr(10) || 'Importance: ' || printf('%.2f', importance) || chr(10),
                                 chr(10) ORDER BY rank, memory_id) AS memories_text FROM near GROUP BY symbol),
{tail}
SELECT symbol, length(txt)::BIGINT AS text_length, sha256(txt) AS text_sha256,
       CASE WHEN contains(txt, 'UPTREND') THEN 'BUY' ELSE 'HOLD' END || ' ' || length(txt) AS action,
       CASE WHEN contains(txt, 'UPTREND') THEN 'confident,optimistic' ELSE 'cautious' END AS sentiment,
       TIMESTAMP '{B.NOW}' AS stored_at, 0.5 AS importance, 1::BIGINT AS n_stored
FROM t"""


@register("analysis_chain", chain_sql())
def analysis_chain(spark, sf):
    """J7 + V20 + S5: every symbol's chain: retrieval hits re-ranked, nearest past decisions, research, indicators and
    context into one text, decided on, stored as a memory (twice: the second run stores nothing) and read back."""
    ctx = written(signals.market_context(signals.latest_indicators(B.bars(spark, sf, "user_id"), 1000)), "chain-context")
    research = written(A.research_text(RS.top_research(QA._symbol_items(spark, sf), by=["symbol"])), "chain-research")
    symbols = written(_symbols(spark, sf), "chain-symbols")
    index = Q._index(spark, sf)
    hits = written(C.insights(index, index.forward.select("doc_id", "content"), C.retrieval_queries(symbols, B.NOW),
                              letter_counts, 26), "chain-insights")
    past = written(QA._decision_memories(spark, sf).withColumn("memory_type", F.lit(C.MEMORY_TYPE)).join(
        B.vectors(spark, sf).withColumnRenamed("vec_id", "memory_id"), "memory_id"), "chain-past")
    path = shared_dir(spark, "decisions")
    for _ in range(2):
        decided = C.run_chain(ctx, research, C.remembered(past, symbols), hits, B.NOW, path, plain_decision, plain_sentiment)
    stored = read_memories(spark, path)
    n = stored.groupBy(F.col("metadata")["symbol"].alias("symbol")).agg(F.count(F.lit(1)).alias("n_stored"))
    last = C.latest_decisions(stored).select("symbol", "action", F.col("timestamp").alias("stored_at"), "importance")
    return decided.join(last, "symbol").join(n, "symbol").select(
        "symbol", F.length("analysis_text").cast("long").alias("text_length"), F.sha2("analysis_text", 256).alias("text_sha256"),
        "action", F.array_join("sentiment", ",").alias("sentiment"), "stored_at", "importance", "n_stored")
