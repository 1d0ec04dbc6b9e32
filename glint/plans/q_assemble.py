"""Research, item formats and analysis text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from glint.functions.text import split_sentiment
from glint.operators import assemble as A
from glint.operators import research as RS
from glint.operators import signals
from glint.plans import bindings as B
from glint.plans import sqlbind as S
from glint.plans.catalog import register, round_doubles
from glint.plans.standins import plain_decision, plain_sentiment

ITEMS_SQL = """items AS (
  SELECT d.doc_id AS item_id,
         CASE d.doc_id % 3 WHEN 0 THEN 'news' WHEN 1 THEN 'academic' ELSE 'financial' END AS source,
         left(d.text, 80) AS title,
         CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE left(d.text, 400) END AS summary,
         d.text AS content, d.n_chars::DOUBLE AS relevance, CAST(e.user_id AS VARCHAR) AS symbol
  FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id)"""

LINE_SQL = """'- ' || title || CASE WHEN summary IS NOT NULL THEN chr(10) || '  Summary: ' || left(summary, 200) || '...'
                    ELSE '' END"""


def _sources(spark, sf):
    items = B.research_items(spark, sf)
    return {s: items.filter(F.col("source") == s).drop("source") for s in RS.SOURCES}


@register("research_union", f"""WITH {ITEMS_SQL}
SELECT item_id, source, title, summary IS NOT NULL AS has_summary, relevance FROM items
WHERE source IN ('news', 'academic')""")
def research_union(spark, sf):
    """The wanted sources (news, academic) as one table, each tagged at its origin."""
    u = RS.gather_research(_sources(spark, sf), ["news", "academic"])
    return u.select("item_id", "source", "title", F.col("summary").isNotNull().alias("has_summary"), "relevance")


@register("research_top", f"""WITH {ITEMS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY relevance DESC, item_id)::INTEGER AS rank
      FROM items)
SELECT source, rank, item_id, round(relevance, 9) AS relevance, {LINE_SQL} AS line FROM r WHERE rank <= 3""")
def research_top(spark, sf):
    """T6 + V20: the three most relevant items of each source, formatted."""
    u = RS.gather_research(_sources(spark, sf), RS.SOURCES)
    t = RS.top_research(u)
    return round_doubles(t.select("source", "rank", "item_id", "relevance",
                                  A.format_research(F.col("title"), F.col("summary"), F.col("content"))
                                  .alias("line")))


def _symbol_items(spark, sf):
    ev = B.table(spark, sf, "events").select(F.col("event_id").alias("item_id"),
                                             F.col("user_id").cast("string").alias("symbol"))
    return B.research_items(spark, sf).join(ev, "item_id", "left")


def _decision_memories(spark, sf):
    """Trading decisions as memories whose content is a JSON decision record."""
    ev = B.table(spark, sf, "events").filter(F.col("event_type") == "purchase")
    rec = F.concat(F.when(F.col("value") > 50, F.lit("BUY")).otherwise(F.lit("SELL")), F.lit(" "), F.col("props"))
    content = F.to_json(F.struct(F.col("user_id").cast("string").alias("symbol"),
                                 F.struct(rec.alias("recommendation")).alias("decision")))
    return ev.select(F.col("event_id").alias("memory_id"), F.col("user_id").cast("string").alias("symbol"),
                     F.col("ts").alias("timestamp"), content.alias("content"),
                     F.least(F.lit(1.0), F.col("value") / 100).alias("importance"))


def _assembled(spark, sf):
    ctx = signals.market_context(signals.latest_indicators(B.bars(spark, sf, "user_id"), 1000))
    research = A.research_text(RS.top_research(_symbol_items(spark, sf), by=["symbol"]))
    mem = _decision_memories(spark, sf).filter(F.col("importance") >= 0.6)
    mem = signals.newest_bars(mem, 5)             # newest five per symbol (a group limit)
    return A.assemble_analysis(ctx, research, A.memories_text(mem))


ANALYSIS_SQL = f"""WITH {S.BARS_USR},
nb AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY "timestamp" DESC) <= 1000),
{S.indicator_select('nb')},
latest AS (SELECT * FROM ind QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY "timestamp" DESC) = 1),
ctx AS (SELECT *, {S.CONTEXT_COLS} FROM latest),
{ITEMS_SQL},
ti AS (SELECT *, row_number() OVER (PARTITION BY symbol, source ORDER BY relevance DESC, item_id) AS rank
       FROM items QUALIFY rank <= 3),
rt AS (SELECT symbol,
         coalesce(string_agg(CASE WHEN source = 'news' THEN {LINE_SQL} END, chr(10) ORDER BY rank, item_id), '') AS news_text,
         coalesce(string_agg(CASE WHEN source = 'academic' THEN {LINE_SQL} END, chr(10) ORDER BY rank, item_id), '') AS academic_text,
         coalesce(string_agg(CASE WHEN source = 'financial' THEN {LINE_SQL} END, chr(10) ORDER BY rank, item_id), '') AS financial_text
       FROM ti GROUP BY symbol),
mem AS (SELECT event_id AS memory_id, CAST(user_id AS VARCHAR) AS symbol, ts, least(1.0, value / 100) AS importance,
               CASE WHEN value > 50 THEN 'BUY' ELSE 'SELL' END || ' ' || props AS rec
        FROM events WHERE event_type = 'purchase' AND least(1.0, value / 100) >= 0.6
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) <= 5),
mt AS (SELECT symbol, string_agg(chr(10) || 'Previous Analysis (' || strftime(ts, '%Y-%m-%d %H:%M') || '):'
                                 || chr(10) || 'Symbol: ' || symbol || chr(10) || 'Decision: ' || left(rec, 200) || '...'
                                 || chr(10) || 'Importance: ' || printf('%.2f', importance) || chr(10),
                                 chr(10) ORDER BY ts, memory_id) AS memories_text
       FROM mem GROUP BY symbol),
a AS (SELECT ctx.*, coalesce(rt.news_text, '') AS news_text, coalesce(rt.academic_text, '') AS academic_text,
             coalesce(rt.financial_text, '') AS financial_text, coalesce(mt.memories_text, '') AS memories_text
      FROM ctx LEFT JOIN rt USING (symbol) LEFT JOIN mt USING (symbol)),
t AS (SELECT symbol, trend, trend_strength, volatility_level, volume_signal, price_momentum,
  chr(10) || '{A.INDENT}Analysis for ' || symbol || ':' || chr(10) || chr(10) || '{A.INDENT}Technical Indicators:'
  || chr(10) || '{A.INDENT}- Current Price: $' || coalesce(printf('%.2f', close), 'None')
  || chr(10) || '{A.INDENT}- SMA20: $' || coalesce(printf('%.2f', sma_20), 'None')
  || chr(10) || '{A.INDENT}- SMA50: $' || coalesce(printf('%.2f', sma_50), 'None')
  || chr(10) || '{A.INDENT}- Z-Score: ' || coalesce(printf('%.2f', z_score), 'None')
  || chr(10) || '{A.INDENT}- Volume Ratio: ' || coalesce(printf('%.2f', volume_ratio), 'None')
  || chr(10) || '{A.INDENT}- Current Trend: ' || trend
  || chr(10) || '{A.INDENT}' || chr(10) || '{A.INDENT}Market Context:' || chr(10) || '{A.INDENT}- Trend Strength: ' || CAST(trend_strength AS VARCHAR)
  || chr(10) || '{A.INDENT}- Volatility Level: ' || volatility_level
  || chr(10) || '{A.INDENT}- Volume Signal: ' || volume_signal
  || chr(10) || '{A.INDENT}- Price Momentum: ' || price_momentum
  || chr(10) || '{A.INDENT}' || chr(10) || '{A.INDENT}RAG System Insights:' || chr(10) || '{A.INDENT}' || 'No highly relevant historical insights found.'
  || chr(10) || '{A.INDENT}' || chr(10) || '{A.INDENT}Recent Research:' || chr(10) || '{A.INDENT}News:' || chr(10) || '{A.INDENT}' || news_text
  || chr(10) || '{A.INDENT}' || chr(10) || '{A.INDENT}Academic Analysis:' || chr(10) || '{A.INDENT}' || academic_text
  || chr(10) || '{A.INDENT}' || chr(10) || '{A.INDENT}Financial Reports:' || chr(10) || '{A.INDENT}' || financial_text
  || chr(10) || '{A.INDENT}' || chr(10) || '{A.INDENT}Relevant Trading History:' || chr(10) || '{A.INDENT}' || memories_text
  || chr(10) || '{A.INDENT}' || chr(10) || '{A.INDENT}Additional Context:' || chr(10) || '{A.INDENT}- Current Market Hours: '
  || strftime(TIMESTAMP '{B.NOW}', '%H:%M:%S')
  || chr(10) || '{A.INDENT}- Market Conditions: '
  || CASE WHEN hour(TIMESTAMP '{B.NOW}') BETWEEN 9 AND 16 THEN 'Normal Trading Hours' ELSE 'Extended Hours' END
  || chr(10) || '{A.INDENT}' AS txt FROM a)
SELECT symbol, trend, trend_strength, volatility_level, volume_signal, price_momentum,
       length(txt)::BIGINT AS text_length, sha256(txt) AS text_sha256 FROM t"""


@register("analysis_text", ANALYSIS_SQL)
def analysis_text(spark, sf):
    """J7 + V19/V20: one analysis context per symbol from indicators, context, research and
    past decisions, in one job; compared by length and SHA-256 of the text."""
    t = A.analysis_text(_assembled(spark, sf), B.NOW)
    return round_doubles(t.select("symbol", "trend", "trend_strength", "volatility_level", "volume_signal",
                                  "price_momentum", F.length("analysis_text").cast("long").alias("text_length"),
                                  F.sha2("analysis_text", 256).alias("text_sha256")))


@register("history_prompt", """WITH h AS (
  SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM conversations GROUP BY 1),
p AS (SELECT c.conv_id, c.turn,
  'Here is a trading decision we want to situate within the overall trading history.' || chr(10) || chr(10)
  || '<history>' || chr(10) || h.history || chr(10) || '</history>' || chr(10) || chr(10) || '<decision>' || chr(10)
  || c.text || chr(10) || '</decision>' || chr(10) || chr(10)
  || 'Please provide a brief context (2-3 sentences) that situates this trading decision within the overall history,'
  || chr(10) || 'focusing on patterns, relationships, and significance. Answer with just the context.' AS prompt
  FROM conversations c JOIN h USING (conv_id) WHERE c.role = 'assistant')
SELECT conv_id, turn, length(prompt)::BIGINT AS prompt_length, sha256(prompt) AS prompt_sha256 FROM p""")
def history_prompt(spark, sf):
    """Each decision (assistant turn) situated in its whole history; the history text
    is built once per conversation and joined, not rebuilt per row."""
    h = B.history(spark, sf)
    from glint.functions.text import collect_text
    hist = h.groupBy("history_id").agg(
        collect_text(F.concat(F.col("role"), F.lit(": "), F.col("content")), F.col("seq")).alias("history"))
    p = (h.filter(F.col("role") == "assistant").join(hist, "history_id")
         .withColumn("prompt", A.history_prompt(F.col("history"), F.col("content"))))
    return p.select(F.col("history_id").alias("conv_id"), F.col("seq").alias("turn"),
                    F.length("prompt").cast("long").alias("prompt_length"),
                    F.sha2("prompt", 256).alias("prompt_sha256"))


@register("sentiment_split", """SELECT conv_id, turn, len(string_split(text, ', '))::INTEGER AS n_parts,
       string_split(text, ', ')[1] AS first_part FROM conversations""")
def sentiment_split(spark, sf):
    """Model sentiment text split on ', '."""
    c = B.table(spark, sf, "conversations")
    parts = split_sentiment("text")
    return c.select("conv_id", "turn", F.size(parts).alias("n_parts"), F.element_at(parts, 1).alias("first_part"))


@register("analysis_assemble", f"""{ANALYSIS_SQL.split('t AS (SELECT symbol, trend')[0].rstrip().rstrip(',')}
SELECT symbol, round(close, 9) AS close, round(sma_20, 9) AS sma_20, trend, volatility_level,
       length(news_text)::BIGINT AS news_length, length(academic_text)::BIGINT AS academic_length,
       length(financial_text)::BIGINT AS financial_length, length(memories_text)::BIGINT AS memories_length
FROM a""")
def analysis_assemble(spark, sf):
    """One row per symbol joining indicators, context, research and past decisions,
    each reduced per symbol before the join."""
    a = _assembled(spark, sf)
    return round_doubles(a.select(
        "symbol", "close", "sma_20", "trend", "volatility_level",
        F.length("news_text").cast("long").alias("news_length"),
        F.length("academic_text").cast("long").alias("academic_length"),
        F.length("financial_text").cast("long").alias("financial_length"),
        F.length("memories_text").cast("long").alias("memories_length")))


@register("trading_decision", ANALYSIS_SQL[:ANALYSIS_SQL.rindex("SELECT symbol, trend")] + """
SELECT symbol, CASE WHEN contains(txt, 'UPTREND') THEN 'BUY' ELSE 'HOLD' END || ' ' || length(txt) AS recommendation,
       true AS confidence, CASE WHEN contains(txt, 'UPTREND') THEN 2 ELSE 1 END::INTEGER AS n_sentiment,
       CASE WHEN contains(txt, 'UPTREND') THEN 'confident' ELSE 'cautious' END AS first_sentiment
FROM t""")
def trading_decision(spark, sf):
    """U3 + V14 + F13: the decision of each analysis and its sentiment, by functions that stand in for a model."""
    d = A.decide(A.analysis_text(_assembled(spark, sf), B.NOW), plain_decision, plain_sentiment)
    return d.select("symbol", "recommendation", "confidence", F.size("sentiment").alias("n_sentiment"),
                    F.element_at("sentiment", 1).alias("first_sentiment"))
