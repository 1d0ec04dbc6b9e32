"""Bindings of the operators' input tables to the given parquet tables.

Each function reads whole tables (projection and filters reach the scan) and
returns the input shape an operator expects. The same bindings are spelled in
SQL in ``glint.plans.sqlbind`` for the DuckDB check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Which event types are memories, and of which type.
MEMORY_TYPE_OF_EVENT = {
    "purchase": "trading_decision",
    "view": "market_event",
    "click": "research_insight",
    "signup": "performance_metric",
    "error": "market_event",
}
MEMORY_TYPES = ["trading_decision", "market_event", "research_insight", "performance_metric"]

# Emotion lists assigned by user.
EMOTION_LISTS = ["confident, optimistic", "cautious", "uncertain, cautious"]

# Research source by pmod(doc_id, 3).
RESEARCH_SOURCES = ["news", "academic", "financial"]

# Fixed "now" of the test runs (never the wall clock).
NOW = "2024-01-30 23:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, symbol: str = "event_type") -> DataFrame:
    """Bar table from ``events``: symbol by event type (few, long series) or user (many, short)."""
    ev = table(spark, sf_dir, "events")
    sym = F.col("event_type") if symbol == "event_type" else F.col("user_id").cast("string")
    return ev.select(sym.alias("symbol"), F.col("ts").alias("timestamp"),
                     F.col("value").alias("close"),
                     F.get_json_object("props", "$.k").cast("double").alias("volume"))


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monitored symbols: users with a sign-up worth more than 50."""
    ev = table(spark, sf_dir, "events")
    return (ev.filter((F.col("event_type") == "signup") & (F.col("value") > 50))
            .select(F.col("user_id").cast("string").alias("symbol")).distinct())


def memories(spark: SparkSession, sf_dir: str, importance_scale: float = 100.0) -> DataFrame:
    """Memory table from ``events``."""
    ev = table(spark, sf_dir, "events")
    mt = F.create_map(*[x for k, v in MEMORY_TYPE_OF_EVENT.items() for x in (F.lit(k), F.lit(v))])
    emo = F.array(*[F.lit(s) for s in EMOTION_LISTS])
    k = F.get_json_object("props", "$.k")
    return (ev.filter(F.col("event_type").isin(list(MEMORY_TYPE_OF_EVENT)))
            .select(F.col("event_id").alias("memory_id"),
                    mt[F.col("event_type")].alias("memory_type"),
                    F.concat(F.col("event_type"), F.lit(" "), F.col("props")).alias("content"),
                    F.col("ts").alias("timestamp"),
                    F.least(F.lit(1.0), F.col("value") / F.lit(importance_scale)).alias("importance"),
                    F.create_map(F.lit("symbol"), F.col("user_id").cast("string"),
                                 F.lit("k"), k).alias("metadata"),
                    F.col("props").alias("context"),
                    F.split(F.element_at(emo, (F.pmod(F.col("user_id"), F.lit(3)) + 1).cast("int")),
                            ", ").alias("emotions")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def memories_with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories that carry an embedding (the store embeds every memory it keeps)."""
    v = vectors(spark, sf_dir).withColumnRenamed("vec_id", "memory_id")
    return memories(spark, sf_dir).join(v, "memory_id")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with metadata, a time (event time of the same id) and an optional vector."""
    d = table(spark, sf_dir, "documents")
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"),
                                               F.col("ts").alias("timestamp"))
    v = vectors(spark, sf_dir).withColumnRenamed("vec_id", "doc_id")
    return (d.select("doc_id", F.col("text").alias("content"),
                     F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
                     .alias("metadata"))
            .repartition("doc_id")          # the texts are dealt once, whichever joins are chosen
            .join(ev, "doc_id", "left").join(v, "doc_id", "left"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval queries from ``benchmark``, vector by ``vec_id = item_id``."""
    b = table(spark, sf_dir, "benchmark")
    v = vectors(spark, sf_dir).withColumnRenamed("vec_id", "query_id")
    return (b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
            .join(v, "query_id", "left"))


def research_items(spark: SparkSession, sf_dir: str, source: str | None = None) -> DataFrame:
    """Research items from ``documents``; news carries no summary."""
    d = table(spark, sf_dir, "documents")
    src = F.element_at(F.array(*[F.lit(s) for s in RESEARCH_SOURCES]),
                       (F.pmod(F.col("doc_id"), F.lit(3)) + 1).cast("int"))
    out = d.select(F.col("doc_id").alias("item_id"), src.alias("source"),
                   F.substring("text", 1, 80).alias("title"),
                   F.array(F.col("source")).alias("authors"),
                   F.when(src == "news", F.lit(None).cast("string"))
                   .otherwise(F.substring("text", 1, 400)).alias("summary"),
                   F.col("text").alias("content"),
                   F.col("n_chars").cast("double").alias("relevance"))
    return out if source is None else out.filter(F.col("source") == source)


def snapshot_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("rag_index_"), F.col("o_orderkey"), F.lit(".pkl")).alias("name"),
                    F.concat(F.lit("/index/"), F.col("o_custkey"), F.lit("/rag_index_"),
                             F.col("o_orderkey"), F.lit(".pkl")).alias("path"),
                    F.col("o_orderdate").alias("mtime"),
                    F.col("o_custkey").alias("series"),
                    F.col("o_orderkey").alias("order_key"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("history_id"), F.col("turn").alias("seq"),
                    F.col("text").alias("content"), F.col("role"))
