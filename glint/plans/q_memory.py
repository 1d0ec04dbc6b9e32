"""Memory table and vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from glint.functions import scalar as SC
from glint.functions.text import fmt_fixed
from glint.operators import memory as M
from glint.operators import vectors as V
from glint.plans import bindings as B
from glint.plans import sqlbind as S
from glint.plans.catalog import register, round_doubles
from glint.functions.vector import norm
from glint.session import shared_dir
from glint.sources.json_rows import DOCUMENT_SCHEMA, from_json_rows, to_json_rows
from glint.sources.memories import read_bars


@register("memory_stats", f"""WITH {S.memories()},
dim AS (SELECT * FROM (VALUES ('trading_decision'), ('market_event'), ('research_insight'),
                              ('performance_metric')) t(memory_type)),
agg AS (SELECT memory_type, count(*) AS n, avg(importance) AS a,
               count(*) FILTER (WHERE importance >= 0.8) AS h
        FROM memories GROUP BY memory_type)
SELECT dim.memory_type, coalesce(n, 0)::BIGINT AS count, round(coalesce(a, 0.0), 9) AS avg_importance,
       coalesce(h, 0)::BIGINT AS high_importance_count
FROM dim LEFT JOIN agg USING (memory_type)""")
def memory_stats(spark, sf):
    return round_doubles(M.memory_stats(B.memories(spark, sf)))


@register("memory_filter", f"""WITH {S.memories()}
SELECT memory_id, memory_type, "timestamp", round(importance, 9) AS importance FROM memories
WHERE memory_type = 'trading_decision' AND importance >= 0.6
  AND "timestamp" BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'""")
def memory_filter(spark, sf):
    m = M.filter_memories(B.memories(spark, sf), memory_type="trading_decision", min_importance=0.6,
                          start="2024-01-05 00:00:00", end="2024-01-20 00:00:00")
    return round_doubles(m.select("memory_id", "memory_type", "timestamp", "importance"))


@register("consolidate", f"""WITH {S.memories(500.0)},
g AS (SELECT memory_type, CAST("timestamp" AS DATE) AS date, count(*) AS source_count,
             max(importance) AS importance,
             string_agg('- ' || content || ' (Importance: ' || printf('%.4f', importance) || ')', E'\\n'
                        ORDER BY "timestamp", memory_id) AS txt
      FROM memories GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT memory_type, strftime(date, '%Y-%m-%d') AS date, source_count, round(importance, 9) AS importance,
       CAST(date AS TIMESTAMP) AS "timestamp", length(txt)::BIGINT AS text_length,
       sha256(txt) AS text_sha256
FROM g""")
def consolidate(spark, sf):
    c = M.consolidate(B.memories(spark, sf, importance_scale=500.0))
    return round_doubles(c.select("memory_type", F.date_format("date", "yyyy-MM-dd").alias("date"),
                                  "source_count", "importance", "timestamp",
                                  F.length("content").cast("long").alias("text_length"),
                                  F.sha2(F.col("content"), 256).alias("text_sha256")))


@register("resolve_importance", f"""WITH {S.memories()},
sc AS (SELECT *, TRY_CAST(trim(CASE WHEN memory_type = 'market_event' THEN 'n/a' ELSE '0.' || k END) AS DOUBLE) AS s
       FROM memories)
SELECT memory_id,
  round(CASE WHEN importance = 1.0
             THEN coalesce(CASE WHEN s IS NOT NULL THEN greatest(0.0, least(1.0, s)) END, 0.5)
             ELSE importance END, 9) AS importance
FROM sc""")
def resolve_importance(spark, sf):
    """Unscored memories (importance exactly 1.0) take a parsed model score."""
    m = B.memories(spark, sf)
    answer = F.when(F.col("memory_type") == "market_event", F.lit("n/a")) \
        .otherwise(F.concat(F.lit("0."), F.col("metadata")["k"]))
    return round_doubles(m.select("memory_id", SC.resolve_importance(
        F.col("importance"), SC.parse_score(answer)).alias("importance")))


_META_SQL = """map_from_entries([('symbol', symbol), ('k', k), ('importance', CAST(importance AS VARCHAR)),
                      ('timestamp', strftime("timestamp", '%Y-%m-%dT%H:%M:%S'))])"""


def _meta_with_reserved(m):
    return F.map_concat(F.col("metadata"), F.create_map(
        F.lit("importance"), F.col("importance").cast("string"),
        F.lit("timestamp"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")))


@register("metadata_strip", f"""WITH {S.memories()},
m AS (SELECT memory_id, map_from_entries(list_filter(map_entries({_META_SQL}),
        lambda e: e.key NOT IN ('importance', 'timestamp', 'context', 'emotions'))) AS meta FROM memories)
SELECT memory_id, array_to_string(list_sort(map_keys(meta)), ',') AS keys, meta['symbol'] AS symbol
FROM m""")
def metadata_strip(spark, sf):
    m = B.memories(spark, sf)
    s = SC.strip_reserved(_meta_with_reserved(m))
    return m.select("memory_id", SC.map_keys_text(s).alias("keys"), s["symbol"].alias("symbol"))


@register("metadata_merge", f"""WITH {S.memories()}
SELECT memory_id, 'importance,k,symbol,timestamp' AS keys,
       printf('%.4f', importance) AS importance, k
FROM memories""")
def metadata_merge(spark, sf):
    """caller metadata (with a stale 'importance') merged with computed keys; computed wins."""
    m = B.memories(spark, sf).withColumn("_imp", fmt_fixed(F.col("importance"), 4))
    caller = F.map_concat(F.col("metadata"), F.create_map(F.lit("importance"), F.lit("stale")))
    computed = F.create_map(F.lit("importance"), F.col("_imp"),
                            F.lit("timestamp"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"))
    merged = SC.merge_metadata(caller, computed)
    return m.select("memory_id", SC.map_keys_text(merged).alias("keys"),
                    merged["importance"].alias("importance"), merged["k"].alias("k"))


@register("json_roundtrip", f"""WITH {S.memories()}
SELECT memory_id, memory_type, content, "timestamp", round(importance, 9) AS importance, symbol,
       len(string_split(CASE user_id % 3 WHEN 0 THEN 'confident, optimistic' WHEN 1 THEN 'cautious'
                                   ELSE 'uncertain, cautious' END, ', '))::BIGINT AS n_emotions
FROM memories""")
def json_roundtrip(spark, sf):
    """Memories to JSON text and back; the fields survive."""
    m = B.memories(spark, sf)
    back = from_json_rows(to_json_rows(m, key="memory_id"), key="memory_id")
    return round_doubles(back.select("memory_id", "memory_type", "content", "timestamp", "importance",
                                     F.col("metadata")["symbol"].alias("symbol"),
                                     F.size("emotions").cast("long").alias("n_emotions")))


_L2_SQL = "list_sum(list_transform(list_zip(q.embedding, m.embedding), lambda t: (t[1]-t[2])*(t[1]-t[2])))"


@register("memory_search", f"""WITH {S.memories()}, {S.QUERIES},
mv AS (SELECT m.*, e.embedding::DOUBLE[] AS embedding FROM memories m JOIN embeddings e ON e.vec_id = m.memory_id
       WHERE m.importance >= 0.3),
d AS (SELECT q.query_id, m.memory_id, {_L2_SQL} AS distance FROM queries q, mv m)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), memory_id)::INTEGER AS rank,
       memory_id, round(distance, 9) AS distance
FROM d QUALIFY rank <= 5""")
def memory_search(spark, sf):
    """T4: five nearest memories (importance >= 0.3) to each query vector, all types."""
    hits = M.search_memories(B.memories_with_vectors(spark, sf), B.queries(spark, sf),
                             limit=5, metric="l2sq", min_importance=0.3)
    return round_doubles(hits)


_DOT_SQL = ("CASE WHEN d.embedding IS NULL THEN 0.0 ELSE "
            "list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda t: t[1]*t[2])) END")


@register("vector_scores", f"""WITH {S.DOCUMENTS}, {S.QUERIES},
s AS (SELECT q.query_id, d.doc_id, {_DOT_SQL} AS score FROM queries q, docs d)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INTEGER AS rank,
       doc_id, round(score, 9) AS score, round(max(score) OVER (PARTITION BY query_id), 9) AS best
FROM s QUALIFY rank <= 10""")
def vector_scores(spark, sf):
    """Exact top 10 documents per query by dot product, and the best score (A5).
    Documents without a vector score 0 (the reference's zero-vector fallback)."""
    d = B.documents(spark, sf).select(F.col("doc_id").alias("item_id"), "embedding")
    hits = V.top_k(d, B.queries(spark, sf), 10, "dot")
    return round_doubles(hits.select("query_id", "rank", F.col("item_id").alias("doc_id"), "score", "best"))


@register("mean_pool", """WITH e AS (SELECT label, unnest(generate_series(0, len(embedding) - 1)) AS pos,
                         unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT label, pos::INTEGER AS pos, round(avg(x), 9) AS x FROM e GROUP BY label, pos""")
def mean_pool(spark, sf):
    """One mean vector per label, shown position by position."""
    pooled = V.mean_pool(B.table(spark, sf, "embeddings"), "label")
    return round_doubles(pooled.select("label", F.posexplode("embedding").alias("pos", "x")))


@register("json_documents", f"""WITH {S.DOCUMENTS}
SELECT doc_id, sha256(content) AS content_sha, lang, source, len(embedding)::INTEGER AS dim,
       round(sqrt(list_sum(list_transform(embedding, lambda x: x * x))), 6) AS norm FROM docs""")
def json_documents(spark, sf):
    """Documents (text, metadata, vector or none) to JSON text and back."""
    d = B.documents(spark, sf).withColumn("embedding", F.col("embedding").cast("array<double>"))
    back = from_json_rows(to_json_rows(d, "doc_id", DOCUMENT_SCHEMA), "doc_id", DOCUMENT_SCHEMA)
    return back.select("doc_id", F.sha2("content", 256).alias("content_sha"), F.col("metadata")["lang"].alias("lang"),
                       F.col("metadata")["source"].alias("source"),
                       F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dim"),
                       F.when(F.col("embedding").isNotNull(), F.round(norm("embedding"), 6)).alias("norm"))


@register("bar_files", f"""WITH {S.BARS_USR}
SELECT symbol, "timestamp", round(close, 9) AS close, round(volume, 9) AS volume FROM bars""")
def bar_files(spark, sf):
    """Bars written as JSON lines by another system, read back as the bar table."""
    path = shared_dir(spark, "bar-files")
    b = B.bars(spark, sf, "user_id")
    b.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).write.json(path)
    return round_doubles(read_bars(spark, path, "json"))


@register("defaults", f"""WITH {S.DOCUMENTS}, {S.memories()}
SELECT m.memory_id, round(coalesce(CASE WHEN m.importance < 0.1 THEN NULL ELSE m.importance END, 0.5), 9) AS importance,
       coalesce(d.content, 'No highly relevant historical insights found.') IS DISTINCT FROM d.content AS no_insights,
       CASE WHEN d.embedding IS NULL THEN 2 ELSE len(d.embedding) END::INTEGER AS dim
FROM memories m LEFT JOIN docs d ON d.doc_id = m.memory_id""")
def defaults(spark, sf):
    """missing importance, insights and vectors take the fallbacks."""
    m = B.memories(spark, sf).select("memory_id", F.when(F.col("importance") >= 0.1, F.col("importance")).alias("importance"))
    d = B.documents(spark, sf).select(F.col("doc_id").alias("memory_id"), F.col("content").alias("insights"), "embedding")
    out = SC.with_defaults(m.join(d, "memory_id", "left"), {
        "importance": SC.DEFAULT_IMPORTANCE, "insights": SC.NO_INSIGHTS, "embedding": [0.0, 0.0]})
    return round_doubles(out.select("memory_id", "importance", (F.col("insights") == SC.NO_INSIGHTS).alias("no_insights"),
                                    F.size("embedding").alias("dim")))
