"""Typed, dated, scored memory records (A1, J8, A2, F3-F5, T4, V19 prompts).

Memories: ``memory_id long, memory_type string, content string, timestamp
timestamp_ntz, importance double, metadata map<string,string>, context string,
emotions array<string>, embedding array<float>``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glint.functions.scalar import day, midnight
from glint.functions.text import collect_text, fmt_fixed
from glint.operators.history import with_pieces
from glint.operators.vectors import top_k
from glint.session import written

# The memory types, all of which appear in statistics.
MEMORY_TYPES = ["trading_decision", "market_event", "research_insight", "performance_metric"]
HIGH_IMPORTANCE = 0.8


def memory_stats(memories: DataFrame, types: list[str] = MEMORY_TYPES) -> DataFrame:
    """Per type: count, average importance (0 when empty), count with importance >= 0.8.

    Partial + final aggregate (one row per type), then a left join from the 4-row
    type dimension so empty types appear with zeros (J8). The dimension is the kept
    side of the outer join, so it cannot be the broadcast side; AQE broadcasts the
    measured aggregate instead.
    """
    spark = memories.sparkSession
    dim = spark.createDataFrame([(t,) for t in types], "memory_type string")
    agg = memories.groupBy("memory_type").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("importance").alias("avg_importance"),
        F.count_if(F.col("importance") >= HIGH_IMPORTANCE).alias("high_importance_count"))
    return (dim.join(agg, "memory_type", "left")
            .select("memory_type",
                    F.coalesce("count", F.lit(0).cast("long")).alias("count"),
                    F.coalesce("avg_importance", F.lit(0.0)).alias("avg_importance"),
                    F.coalesce("high_importance_count", F.lit(0).cast("long")).alias("high_importance_count")))


def filter_memories(memories: DataFrame, memory_type: str | None = None, min_importance: float = 0.0,
                    start=None, end=None) -> DataFrame:
    """Importance ``>=`` bound (only when above 0), time range, each given end
    included (as timestamps), one type or all. Plain predicates, so they reach the
    parquet scan; on a stored table the type is a partition column and is pruned."""
    out = memories
    if memory_type is not None:
        out = out.filter(F.col("memory_type") == memory_type)
    if min_importance > 0:
        out = out.filter(F.col("importance") >= F.lit(min_importance))
    if start is not None:
        out = out.filter(F.col("timestamp") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out.filter(F.col("timestamp") <= F.lit(end).cast("timestamp_ntz"))
    return out


def search_memories(memories: DataFrame, queries: DataFrame, limit: int = 5, metric: str = "l2sq",
                    **filters) -> DataFrame:
    """T4: nearest memories per query across all chosen types; same answer as the
    reference's per-type top-n followed by a merge. Distance is squared L2 by default."""
    m = filter_memories(memories, **filters).filter(F.col("embedding").isNotNull())
    hits = top_k(m, queries, limit, metric, item_id="memory_id")
    return hits.select("query_id", "rank", F.col("item_id").alias("memory_id"),
                       F.col("score").alias("distance"))


def memory_line(content, importance) -> F.Column:
    """'- {content} (Importance: {x})' with importance to 4 places."""
    return F.concat(F.lit("- "), content, F.lit(" (Importance: "),
                    fmt_fixed(importance, 4), F.lit(")"))


def consolidation_prompt(date, memories_text) -> F.Column:
    # Fixed value: text that asks a model for a summary (an interface; V19).
    return F.concat(F.lit("Analyze these trading memories from "), F.date_format(date, "yyyy-MM-dd"),
                    F.lit(" and create a consolidated insight:\n\nMemories:\n"), memories_text,
                    F.lit("\n\nCreate a concise summary that captures the key patterns and insights."))


def consolidate(memories: DataFrame, summarizer=None, include_consolidated: bool = False,
                memory_type: str | None = None, rows_per_piece: int = 10_000, fan: int = 16) -> DataFrame:
    """A2: per (type, date) with at least 2 memories, one consolidated memory; ``memory_type`` takes one type only.

    Importance is the day's maximum, timestamp is midnight. Earlier consolidated memories are left out unless asked
    for. A day's memories are cut into ordered pieces of about ``rows_per_piece`` rows. Without a ``summarizer`` the
    text is the day's lines in time order: pieces are joined first, and only the last step sees a whole day. A
    ``summarizer`` (DataFrame -> DataFrame over column ``prompt`` adding ``summary``) is given one piece at a time, then
    the summaries of ``fan`` neighbouring pieces, and so on up to the day, so that no text grows with the day.
    """
    m = memories
    if memory_type is not None:
        m = m.filter(F.col("memory_type") == memory_type)
    if not include_consolidated:
        m = m.filter(F.coalesce(F.col("metadata")["type"], F.lit("")) != "consolidated_memory")
    m = m.withColumn("date", day("timestamp"))
    m = m.withColumn("_day", F.concat_ws("|", F.coalesce("memory_type", F.lit("")), "date"))
    g = (with_pieces(m, "_day", "timestamp", rows_per_piece, "_piece").groupBy("memory_type", "date", "_piece")
         .agg(F.count(F.lit(1)).alias("source_count"), F.max("importance").alias("importance"),
              collect_text(memory_line(F.col("content"), F.col("importance")),
                           F.col("timestamp"), F.col("memory_id")).alias("memories_text")))
    whole = Window.partitionBy("memory_type", "date")
    g = g.withColumn("_all", F.sum("source_count").over(whole)).filter(F.col("_all") >= 2).drop("_all")

    def joined(level: DataFrame, text: str, piece) -> DataFrame:
        return level.groupBy("memory_type", "date", piece.alias("_up")).agg(
            F.sum("source_count").alias("source_count"), F.max("importance").alias("importance"),
            collect_text(F.col(text), F.col("_piece")).alias("memories_text")).withColumnRenamed("_up", "_piece")

    if summarizer is None:
        g = joined(g, "memories_text", F.lit(0).cast("long")).withColumn("content", F.col("memories_text"))
    else:
        while True:
            asked = g.withColumn("prompt", consolidation_prompt(F.col("date"), F.col("memories_text")))
            g = written(summarizer(asked), "consolidation")
            if (g.agg(F.max("_piece")).first()[0] or 0) == 0:
                break
            g = joined(g, "summary", F.floor(F.col("_piece") / F.lit(fan)))
        g = g.withColumn("content", F.col("summary")).drop("summary")
    g = g.drop("_piece")
    return (g.withColumn("timestamp", midnight("date"))
            .withColumn("metadata", F.create_map(
                F.lit("type"), F.lit("consolidated_memory"),
                F.lit("source_count"), F.col("source_count").cast("string"),
                F.lit("date"), F.date_format("date", "yyyy-MM-dd"))))


def importance_prompt(memory_type, content, context) -> F.Column:
    """Text that asks a model for an importance in [0, 1]."""
    # Fixed value: the text is an interface.
    return F.concat(F.lit("Analyze the importance of this trading-related memory (0.0 to 1.0):\n\nType: "),
                    memory_type, F.lit("\nContent: "), content,
                    F.lit("\nContext: "), F.coalesce(context, F.lit("None")),
                    F.lit("\n\nConsider:\n1. Financial impact\n2. Long-term relevance\n"
                          "3. Uniqueness of insight\n4. Market significance\n\n"
                          "Return only a float between 0.0 and 1.0."))
