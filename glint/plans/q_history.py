"""Watchlist, throttle, cache, snapshot log and as-of queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from glint.operators import history as H
from glint.operators import sets
from glint.plans import bindings as B
from glint.plans import sqlbind as S
from glint.plans.catalog import register, round_doubles


def _users(spark, sf, etype, above):
    ev = B.table(spark, sf, "events")
    return ev.filter((F.col("event_type") == etype) & (F.col("value") > above)) \
        .select(F.col("user_id").cast("string").alias("symbol"))


@register("watchlist_add", f"""WITH {S.WATCHLIST}
SELECT symbol FROM watchlist
UNION
SELECT CAST(user_id AS VARCHAR) AS symbol FROM events WHERE event_type = 'error' AND value > 50""")
def watchlist_add(spark, sf):
    return sets.watchlist_add(B.watchlist(spark, sf), _users(spark, sf, "error", 50))


@register("watchlist_remove", f"""WITH {S.WATCHLIST}
SELECT symbol FROM watchlist
WHERE symbol NOT IN (SELECT CAST(user_id AS VARCHAR) FROM events
                     WHERE event_type = 'purchase' AND value > 90)""")
def watchlist_remove(spark, sf):
    return sets.watchlist_remove(B.watchlist(spark, sf), _users(spark, sf, "purchase", 90))


def _last_run(spark, sf):
    ev = B.table(spark, sf, "events").filter(F.col("event_type") == "view")
    return ev.groupBy(F.col("user_id").cast("string").alias("symbol")) \
        .agg(F.max("ts").alias("last_analysis"))


@register("due_symbols", f"""WITH {S.WATCHLIST},
last_run AS (SELECT CAST(user_id AS VARCHAR) AS symbol, max(ts) AS last_analysis
             FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT w.symbol, l.last_analysis FROM watchlist w LEFT JOIN last_run l USING (symbol)
WHERE l.last_analysis IS NULL
   OR l.last_analysis <= TIMESTAMP '{B.NOW}' - INTERVAL 300 SECOND""")
def due_symbols(spark, sf):
    return sets.due_symbols(B.watchlist(spark, sf), _last_run(spark, sf), B.NOW, 300)


def _cache(spark, sf):
    ev = B.table(spark, sf, "events")
    return ev.select(F.col("user_id").cast("string").alias("symbol"), "ts", "event_id",
                     F.col("value").alias("payload"))


LATEST_SQL = """SELECT CAST(user_id AS VARCHAR) AS symbol, ts, event_id, round(value, 9) AS payload
FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""


@register("latest_per_key", LATEST_SQL)
def latest_per_key(spark, sf):
    return round_doubles(H.latest_per_key(_cache(spark, sf), "symbol", "ts", "event_id"))


@register("fresh_only", f"""SELECT * FROM ({LATEST_SQL}) t
WHERE ts > TIMESTAMP '{B.NOW}' - INTERVAL 3600 SECOND""")
def fresh_only(spark, sf):
    latest = H.latest_per_key(_cache(spark, sf), "symbol", "ts", "event_id")
    return round_doubles(sets.fresh_only(latest, "ts", B.NOW, 3600))


@register("throttle", """WITH RECURSIVE nx AS (
  SELECT event_type AS symbol, event_id, ts,
         first_value(event_id) OVER (PARTITION BY event_type ORDER BY ts
             RANGE BETWEEN INTERVAL 300 SECOND FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn
  FROM events),
chain AS (SELECT symbol, event_id FROM nx WHERE rn = 1
          UNION ALL
          SELECT nx.symbol, nx.nxt FROM chain JOIN nx ON nx.event_id = chain.event_id
          WHERE nx.nxt IS NOT NULL)
SELECT event_id, event_type AS symbol, ts FROM events
WHERE event_id IN (SELECT event_id FROM chain)""")
def throttle(spark, sf):
    ev = B.table(spark, sf, "events").select("event_id", F.col("event_type").alias("symbol"), "ts")
    return H.throttle(ev, key="symbol", ts="ts", id_col="event_id", gap_seconds=300)


@register("snapshot_retention", """WITH log AS (
  SELECT 'rag_index_' || o_orderkey || '.pkl' AS name, o_orderdate AS mtime, o_custkey AS series
  FROM orders)
SELECT series, name, mtime FROM log WHERE regexp_matches(name, '^rag_index_.*\\.pkl$')
QUALIFY row_number() OVER (PARTITION BY series ORDER BY mtime DESC, name) > 5""")
def snapshot_retention(spark, sf):
    return H.retention(B.snapshot_log(spark, sf), keep=5).select("series", "name", "mtime")


@register("latest_snapshot", """WITH log AS (
  SELECT 'rag_index_' || o_orderkey || '.pkl' AS name,
         '/index/' || o_custkey || '/rag_index_' || o_orderkey || '.pkl' AS path,
         o_orderdate AS mtime, o_custkey AS series
  FROM orders)
SELECT series, name, path, mtime FROM log
QUALIFY row_number() OVER (PARTITION BY series ORDER BY mtime DESC, name) = 1""")
def latest_snapshot(spark, sf):
    return H.latest_snapshot(B.snapshot_log(spark, sf))


@register("asof_context", """WITH d AS (
  SELECT event_id AS decision_id, CAST(user_id AS VARCHAR) AS symbol, ts AS "timestamp"
  FROM events WHERE event_type = 'purchase'),
b AS (SELECT CAST(user_id AS VARCHAR) AS symbol, ts AS bar_ts, value AS close
      FROM events WHERE event_type = 'view')
SELECT d.decision_id, d.symbol, d."timestamp", b.bar_ts AS bar_timestamp, round(b.close, 9) AS bar_close
FROM d ASOF LEFT JOIN b ON d.symbol = b.symbol AND d."timestamp" >= b.bar_ts""")
def asof_context(spark, sf):
    ev = B.table(spark, sf, "events")
    dec = ev.filter(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("decision_id"), F.col("user_id").cast("string").alias("symbol"),
        F.col("ts").alias("timestamp"))
    bars = ev.filter(F.col("event_type") == "view").select(
        F.col("user_id").cast("string").alias("symbol"), F.col("ts").alias("timestamp"),
        F.col("value").alias("close"))
    out = H.asof_join(dec, bars)
    return round_doubles(out.select("decision_id", "symbol", "timestamp",
                                    F.col("right.timestamp").alias("bar_timestamp"),
                                    F.col("right.close").alias("bar_close")))
