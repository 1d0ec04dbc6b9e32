"""Model hook and memory store queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from glint.operators import memory as M
from glint.operators import models as MD
from glint.functions.vector import norm
from glint.plans import bindings as B
from glint.plans import sqlbind as S
from glint.plans.catalog import register, round_doubles
from glint.session import shared_dir
from glint.sources.memories import read_memories


@register("fill_embeddings", f"""WITH {S.DOCUMENTS}
SELECT doc_id, CASE WHEN embedding IS NULL THEN 'computed' ELSE 'stored' END AS vector_source,
       64 AS dim,
       round(CASE WHEN embedding IS NOT NULL THEN sqrt(list_sum(list_transform(embedding, lambda x: x * x)))
                  WHEN len({S.tokens('content')}) > 0 THEN 1.0 ELSE 0.0 END, 6) AS norm
FROM docs""")
def fill_embeddings_q(spark, sf):
    """J6 + U1: stored vectors kept, missing ones computed by the default embedder
    (feature hashing, L2-normalised; only rows without a vector are embedded)."""
    d = B.documents(spark, sf).select("doc_id", "content", "embedding")
    out = MD.fill_embeddings(d)
    return out.select("doc_id", "vector_source", F.size("embedding").alias("dim"),
                      F.round(norm("embedding"), 6).alias("norm"))


def length_scorer(prompts):
    """A deterministic stand-in for a model: importance from the prompt length."""
    return [f"{(len(p) % 97) / 100:.2f}" for p in prompts]


_PROMPT_LEN = ("length('Analyze the importance of this trading-related memory (0.0 to 1.0):' || chr(10) || chr(10)"
               " || 'Type: ' || memory_type || chr(10) || 'Content: ' || content || chr(10) || 'Context: '"
               " || coalesce(context, 'None') || chr(10) || chr(10) || 'Consider:' || chr(10)"
               " || '1. Financial impact' || chr(10) || '2. Long-term relevance' || chr(10)"
               " || '3. Uniqueness of insight' || chr(10) || '4. Market significance' || chr(10) || chr(10)"
               " || 'Return only a float between 0.0 and 1.0.')")


@register("score_importance", f"""WITH {S.memories()}
SELECT memory_id, round(CASE WHEN importance = 1.0 THEN (({_PROMPT_LEN} % 97) / 100.0)::DOUBLE
                             ELSE importance END, 9) AS importance
FROM memories""")
def score_importance(spark, sf):
    """Unscored memories (importance 1.0) scored in batches by a model function."""
    m = MD.score_importance(B.memories(spark, sf), length_scorer)
    return round_doubles(m.select("memory_id", "importance"))


def first_line_summarizer(prompts):
    """A deterministic stand-in summary: the first memory line, 80 characters."""
    return [p.split("\n")[3][:80] for p in prompts]


@register("enrich", f"""WITH {S.memories(500.0)}
SELECT memory_type, strftime(CAST("timestamp" AS DATE), '%Y-%m-%d') AS date,
       left(arg_min('- ' || content || ' (Importance: ' || printf('%.4f', importance) || ')',
                    ("timestamp", memory_id)), 80) AS summary
FROM memories GROUP BY memory_type, CAST("timestamp" AS DATE) HAVING count(*) >= 2""")
def enrich(spark, sf):
    """Consolidated memories summarised by a text function run in batches."""
    summarize = lambda df: MD.enrich(df, "prompt", first_line_summarizer, "summary", "")
    c = M.consolidate(B.memories(spark, sf, importance_scale=500.0), summarizer=summarize)
    return c.select("memory_type", F.date_format("date", "yyyy-MM-dd").alias("date"),
                    F.col("content").alias("summary"))


@register("append_memories", f"""WITH {S.memories()}
SELECT memory_type, count(*)::BIGINT AS count,
       round(avg(CASE WHEN importance = 1.0 THEN 0.5 ELSE importance END), 9) AS avg_importance
FROM memories GROUP BY memory_type""")
def append_memories(spark, sf):
    """S5 + S4: memories scored (no model: 0.5), embedded, written partitioned by type,
    the same batch replayed (idempotent: nothing written twice), read back."""
    path = shared_dir(spark, "memories")
    m = B.memories(spark, sf).select("memory_id", "memory_type", "content", "timestamp", "importance",
                                     "metadata", "context", "emotions")
    MD.append_memories(m, path)
    MD.append_memories(m, path)              # replay
    stored = read_memories(spark, path)
    return round_doubles(stored.groupBy("memory_type").agg(
        F.count(F.lit(1)).alias("count"), F.avg("importance").alias("avg_importance")))
