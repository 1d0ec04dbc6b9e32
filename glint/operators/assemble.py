"""Text assembly per symbol: item formats, prompts and the analysis context.

Every input is reduced to one row per symbol first (partial + final aggregates
over bounded top-n groups), then joined on symbol: the joins meet one row per
symbol on each side, whatever the size of the inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glint.functions.scalar import NO_INSIGHTS
from glint.functions.text import clip, collect_text, fmt2, session_label

INDENT = "        "
HIT_CHARS = 300             # shown of a retrieval hit


def format_research(title, summary, content) -> F.Column:
    """'- title' (+ '  Summary: <200 chars>...') or '- <200 chars of content>...' (V20)."""
    with_title = F.concat(F.lit("- "), title,
                          F.when(summary.isNotNull(), F.concat(F.lit("\n  Summary: "), clip(summary, 200)))
                          .otherwise(F.lit("")))
    return F.when(title.isNotNull(), with_title).otherwise(F.concat(F.lit("- "), clip(content, 200)))


def format_hit(content, relevance, rerank) -> F.Column:
    """One retrieval insight (V20); missing scores print as 0.00."""
    return F.concat(F.lit("\nInsight:\n"), clip(content, HIT_CHARS),
                    F.lit("\nRelevance: "), fmt2(F.coalesce(relevance, F.lit(0.0))),
                    F.lit("\nReranking Score: "), fmt2(F.coalesce(rerank, F.lit(0.0))), F.lit("\n"))


def format_memory(ts, symbol, recommendation, importance) -> F.Column:
    """One past analysis (V20); NULL when the memory is not a decision record."""
    return F.when(recommendation.isNotNull(), F.concat(
        F.lit("\nPrevious Analysis ("), F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit("):\nSymbol: "),
        symbol, F.lit("\nDecision: "), clip(recommendation, 200),
        F.lit("\nImportance: "), fmt2(importance), F.lit("\n")))


def research_text(items: DataFrame, key: str = "symbol") -> DataFrame:
    """Per key and source: formatted items joined by newline (A9), in rank order."""
    line = format_research(F.col("title"), F.col("summary"), F.col("content"))
    return (items.groupBy(key).agg(
        *[collect_text(F.when(F.col("source") == s, line), F.col("rank"), F.col("item_id"))
          .alias(f"{s}_text") for s in ["news", "academic", "financial"]]))


def memories_text(memories: DataFrame, key: str = "symbol") -> DataFrame:
    line = format_memory(F.col("timestamp"), F.col(key),
                         F.get_json_object("content", "$.decision.recommendation"), F.col("importance"))
    return memories.groupBy(key).agg(
        collect_text(line, F.col("timestamp"), F.col("memory_id")).alias("memories_text"))


def hits_text(hits: DataFrame, key: str = "symbol") -> DataFrame:
    line = format_hit(F.col("content"), F.col("relevance_score"), F.col("reranking_score"))
    return hits.groupBy(key).agg(collect_text(line, F.col("rank"), F.col("doc_id")).alias("insights_text"))


def assemble_analysis(context: DataFrame, research: DataFrame | None = None,
                      memories: DataFrame | None = None, hits: DataFrame | None = None,
                      key: str = "symbol") -> DataFrame:
    """One row per symbol with the indicator / context columns and the text blocks."""
    out = context
    for part in (research, memories, hits):
        if part is not None:
            out = out.join(part, key, "left")
    for c in ["news_text", "academic_text", "financial_text", "memories_text"]:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(""))
        else:
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit("")))
    if "insights_text" not in out.columns:
        out = out.withColumn("insights_text", F.lit(None).cast("string"))
    out = out.withColumn("insights_text", F.when(F.coalesce(F.col("insights_text"), F.lit("")) == "",
                                                 F.lit(NO_INSIGHTS)).otherwise(F.col("insights_text")))
    return out


def _num(c: str) -> F.Column:
    return F.coalesce(fmt2(F.col(c)), F.lit("None"))


def analysis_text(a: DataFrame, now) -> DataFrame:
    """The analysis context of each symbol, at time ``now`` (a column or literal)."""
    now_c = F.lit(now).cast("timestamp_ntz") if isinstance(now, str) else now
    i = INDENT
    txt = F.concat(
        F.lit(f"\n{i}Analysis for "), F.col("symbol"), F.lit(f":\n\n{i}Technical Indicators:\n{i}- Current Price: $"),
        _num("close"), F.lit(f"\n{i}- SMA20: $"), _num("sma_20"), F.lit(f"\n{i}- SMA50: $"), _num("sma_50"),
        F.lit(f"\n{i}- Z-Score: "), _num("z_score"), F.lit(f"\n{i}- Volume Ratio: "), _num("volume_ratio"),
        F.lit(f"\n{i}- Current Trend: "), F.col("trend"),
        F.lit(f"\n{i}\n{i}Market Context:\n{i}- Trend Strength: "), F.col("trend_strength").cast("string"),
        F.lit(f"\n{i}- Volatility Level: "), F.col("volatility_level"),
        F.lit(f"\n{i}- Volume Signal: "), F.col("volume_signal"),
        F.lit(f"\n{i}- Price Momentum: "), F.col("price_momentum"),
        F.lit(f"\n{i}\n{i}RAG System Insights:\n{i}"), F.col("insights_text"),
        F.lit(f"\n{i}\n{i}Recent Research:\n{i}News:\n{i}"), F.col("news_text"),
        F.lit(f"\n{i}\n{i}Academic Analysis:\n{i}"), F.col("academic_text"),
        F.lit(f"\n{i}\n{i}Financial Reports:\n{i}"), F.col("financial_text"),
        F.lit(f"\n{i}\n{i}Relevant Trading History:\n{i}"), F.col("memories_text"),
        F.lit(f"\n{i}\n{i}Additional Context:\n{i}- Current Market Hours: "), F.date_format(now_c, "HH:mm:ss"),
        F.lit(f"\n{i}- Market Conditions: "), session_label(now_c), F.lit(f"\n{i}"))
    return a.withColumn("analysis_text", txt)


def history_prompt(history_text, decision) -> F.Column:
    """Situating prompt of one decision within the whole history."""
    return F.concat(
        F.lit("Here is a trading decision we want to situate within the overall trading history.\n\n"
              "<history>\n"), history_text, F.lit("\n</history>\n\n<decision>\n"), decision,
        F.lit("\n</decision>\n\nPlease provide a brief context (2-3 sentences) that situates this trading "
              "decision within the overall history,\nfocusing on patterns, relationships, and significance. "
              "Answer with just the context."))


def decide(analyses: DataFrame, decide_fn=None, sentiment_fn=None, text: str = "analysis_text") -> DataFrame:
    """Decision record per analysis (U3 + V14 + F13): ``recommendation``, ``confidence``
    (the model finished normally), ``sentiment`` (its answer split on ', ').

    ``decide_fn(texts) -> [(text, finished)]`` and ``sentiment_fn(texts) -> [text]`` run in
    batches on the executors; without them, or when a batch fails, the record is the
    reference's error decision: 'Error analyzing trading opportunity', False, ['uncertain'].
    """
    from glint.functions.scalar import ERROR_DECISION, ERROR_SENTIMENT
    from glint.functions.text import split_sentiment
    from glint.operators.models import enrich

    def as_text(fn):
        if fn is None:
            return None

        def run(texts):
            return ["\x1f".join([str(a), "1" if f else "0"]) for a, f in fn(texts)]
        return run
    d = enrich(analyses, text, as_text(decide_fn), "_d", "")
    d = d.withColumn("recommendation", F.when(F.col("_d") == "", F.lit(ERROR_DECISION))
                     .otherwise(F.substring_index("_d", "\x1f", 1)))
    d = d.withColumn("confidence", F.coalesce(F.substring_index("_d", "\x1f", -1) == "1", F.lit(False))
                     & (F.col("_d") != ""))
    d = enrich(d, "recommendation", sentiment_fn, "_s", "")
    failed = (F.col("_d") == "") | (F.col("_s") == "")      # a failed decision has no sentiment call
    return (d.withColumn("sentiment", F.when(failed, F.array(F.lit(ERROR_SENTIMENT)))
                         .otherwise(split_sentiment("_s")))
            .drop("_d", "_s"))
