"""Stream queries: each writes its input as JSON lines in 4 parts in time order (derived
from ``events``; a part is as many files as its rows need and one micro-batch), runs the stream to completion (``availableNow``) and returns the
sink read back; the oracle is the SQL of the batch twin (S2, S3, X1-X6)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from glint.functions.scalar import ntz_micros

from glint.plans import bindings as B
from glint.plans import sqlbind as S
from glint.plans.catalog import register, round_doubles
from glint.session import shared_dir
from glint.streaming import cache as CA
from glint.streaming import market as MK
from glint.streaming import state as ST

N_PARTS = 4
FILE_ROWS = 250_000         # a part of so many rows more is written as one file more, by a task of its own


def _in_parts(rows, order, write) -> int:
    """Write ``rows`` in parts of about equal size, by the values of ``order``, one after the other (the file source
    takes files by time): ``write(part, i)``. Returns the files of a part, the same for every part."""
    cuts = [r / N_PARTS for r in range(1, N_PARTS)]
    cuts = sorted(set(rows.agg(F.percentile_approx(order, cuts, 1000)).first()[0] or []))
    at = F.when(order.isNotNull(), sum(((order > c).cast("int") for c in cuts), F.lit(0)))
    held = {r["_p"]: r["n"] for r in rows.groupBy(at.alias("_p")).agg(F.count(F.lit(1)).alias("n")).collect()
            if r["_p"] is not None}
    files = max(1, min(held.values(), default=0) // FILE_ROWS)
    for i in sorted(held) or [0]:
        part = rows.filter(at == i)
        write(part.coalesce(1) if files == 1 else part.repartition(files), i)
    return files


def _message_files(spark, sf, symbol="user", mixed=True) -> tuple[str, dict]:
    """Market messages from events, in parts by time, and the options with which a stream takes a part at once.

    ``mixed``: clicks are trades sent as a one-element list, purchases are quotes,
    and error events below 5 become broken records; otherwise every event is a bar.
    """
    ev = B.table(spark, sf, "events")
    sym = F.col("user_id").cast("string") if symbol == "user" else F.col("event_type")
    kind = (F.when(F.col("event_type") == "click", "trade").when(F.col("event_type") == "purchase", "quote")
            .otherwise("bar")) if mixed else F.lit("bar")
    msg = F.struct(kind.alias("kind"), sym.alias("symbol"),
                   F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
                   F.col("value").alias("close"),
                   F.get_json_object("props", "$.k").cast("double").alias("volume"))
    value = F.to_json(msg)
    if mixed:
        value = (F.when(F.col("event_type") == "click", F.to_json(F.array(msg)))
                 .when((F.col("event_type") == "error") & (F.col("value") < 5),
                       F.concat(F.lit('{"kind": "bar", "symbol": '), F.col("event_id")))
                 .otherwise(value))
    base = shared_dir(spark, "messages")
    files = _in_parts(ev.select(ntz_micros("ts").alias("_at"), value.alias("value")), F.col("_at"),
                      lambda part, i: part.select("value").write.text(f"{base}/q{i}"))
    return f"{base}/q*/part-*", {"maxFilesPerTrigger": str(files)}


def _run(query):
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


_MSG_SQL = f"""WITH {S.WATCHLIST}
SELECT CAST(user_id AS VARCHAR) AS symbol, ts AS "timestamp", round(value, 9) AS close,
       round(CAST(json_extract_string(props, '$.k') AS DOUBLE), 9) AS volume
FROM events
WHERE event_type IN ('view', 'signup', 'error') AND NOT (event_type = 'error' AND value < 5)
  AND CAST(user_id AS VARCHAR) IN (SELECT symbol FROM watchlist)"""


@register("stream_ingest", _MSG_SQL)
def stream_ingest(spark, sf):
    """S2 + X1: decode records (objects and lists; broken ones quarantined), keep bars of
    monitored symbols, append them to the bar table."""
    return round_doubles(spark.read.parquet(_ingested(spark, sf)[0]).drop("batch"))


def _ingested(spark, sf) -> tuple[str, str]:
    src, at_once = _message_files(spark, sf)
    out, ck = shared_dir(spark, "bars"), shared_dir(spark, "ckpt")
    raw = MK.read_market_stream(spark, "text", src, at_once)
    _run(MK.ingest_bars(raw, B.watchlist(spark, sf), out, ck, quarantine=out + "_bad"))
    return out, out + "_bad"


@register("stream_quarantine", """SELECT '{"kind": "bar", "symbol": ' || event_id AS value FROM events
WHERE event_type = 'error' AND value < 5""")
def stream_quarantine(spark, sf):
    """The broken records of the same stream, kept apart as they came."""
    return spark.read.parquet(_ingested(spark, sf)[1]).drop("batch")


@register("stream_publish", """SELECT CASE event_type WHEN 'click' THEN 'trade' WHEN 'purchase' THEN 'quote'
                                 ELSE 'bar' END AS kind,
       CAST(user_id AS VARCHAR) AS symbol, count(*)::BIGINT AS n
FROM events WHERE NOT (event_type = 'error' AND value < 5) GROUP BY 1, 2""")
def stream_publish(spark, sf):
    """S3: decoded messages published again as JSON values keyed by symbol (a text sink
    stands in for the topic), then read back and counted per kind and symbol."""
    src, at_once = _message_files(spark, sf)
    out, ck = shared_dir(spark, "topic"), shared_dir(spark, "ckpt")
    good, _ = MK.decode_messages(MK.read_market_stream(spark, "text", src, at_once))
    enc = MK.encode_messages(good).select("value")
    _run(MK.write_market_stream(enc, "text", ck, path=out))
    back, _ = MK.decode_messages(spark.read.text(out))
    return back.groupBy("kind", "symbol").agg(F.count(F.lit(1)).alias("n"))


def _bar_stream(spark, sf):
    src, at_once = _message_files(spark, sf, symbol="type", mixed=False)
    good, _ = MK.decode_messages(MK.read_market_stream(spark, "text", src, at_once))
    return good.select("symbol", "timestamp", "close", "volume")


@register("stream_indicators", f"""WITH {S.BARS_EVT},
{S.indicator_select('bars')}
SELECT {S.IND_COLS}, false AS late FROM ind""")
def stream_indicators(spark, sf):
    """Running indicators per symbol with keyed state (last 50 bars); equal to the
    batch windows over the same rows."""
    out, ck = shared_dir(spark, "ind"), shared_dir(spark, "ckpt")
    s = ST.stream_indicators(_bar_stream(spark, sf))
    _run(s.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
         .outputMode("append").trigger(availableNow=True).start())
    return round_doubles(spark.read.parquet(out))


@register("stream_throttle", """WITH RECURSIVE nx AS (
  SELECT event_type AS symbol, event_id, ts,
         first_value(event_id) OVER (PARTITION BY event_type ORDER BY ts
             RANGE BETWEEN INTERVAL 300 SECOND FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn
  FROM events),
chain AS (SELECT symbol, event_id FROM nx WHERE rn = 1
          UNION ALL
          SELECT nx.symbol, nx.nxt FROM chain JOIN nx ON nx.event_id = chain.event_id
          WHERE nx.nxt IS NOT NULL)
SELECT event_type AS symbol, ts AS "timestamp" FROM events
WHERE event_id IN (SELECT event_id FROM chain)""")
def stream_throttle(spark, sf):
    """At most one accepted event per symbol per 5 minutes, state = last accepted time."""
    out, ck = shared_dir(spark, "thr"), shared_dir(spark, "ckpt")
    bars = _bar_stream(spark, sf).withColumn("id", ntz_micros("timestamp"))
    s = ST.stream_throttle(bars.select("symbol", "timestamp", "id"), 300)
    _run(s.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
         .outputMode("append").trigger(availableNow=True).start())
    return spark.read.parquet(out).select("symbol", "timestamp")


@register("stream_latest", f"""WITH m AS (
  SELECT CAST(user_id AS VARCHAR) AS symbol, ts, value AS close FROM events
  WHERE NOT (event_type = 'error' AND value < 5))
SELECT symbol, ts, round(close, 9) AS close FROM m
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, close DESC) = 1
  AND ts > TIMESTAMP '{B.NOW}' - INTERVAL 3600 SECOND""")
def stream_latest(spark, sf):
    """Newest message per symbol as keyed state that expires, served from the state when younger than 1 h."""
    src, at_once = _message_files(spark, sf)
    ck = shared_dir(spark, "ckpt")
    good, _ = MK.decode_messages(MK.read_market_stream(spark, "text", src, at_once))
    rows = good.select("symbol", F.col("timestamp").alias("ts"), "close")
    _run(CA.start_cache(rows, ck, "symbol", "ts", "close", 3600, lag_seconds=7200))
    return round_doubles(CA.read_cache(spark, ck, B.NOW, 3600).select("symbol", "ts", "close"))


def _memory_files(spark, sf, scale=100.0):
    m = B.memories(spark, sf, importance_scale=scale).select(
        "memory_id", "memory_type", "content", "timestamp", "importance", "metadata", "context", "emotions")
    base = shared_dir(spark, "memfeed")
    files = _in_parts(m, F.col("memory_id"), lambda part, i: part.write.parquet(f"{base}/q{i}"))
    return base, m.schema, files


def _stream_memories(spark, sf, scale):
    base, schema, files = _memory_files(spark, sf, scale)
    path = shared_dir(spark, "memtable")
    for attempt in range(2):          # the second run replays every batch: nothing is added
        ck = shared_dir(spark, "ckpt")
        src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
               .parquet(f"{base}/q*/part-*"))
        _run(src.writeStream.foreachBatch(ST.memories_sink(path)).option("checkpointLocation", ck)
             .trigger(availableNow=True).start())
    return path


@register("stream_memories", f"""WITH {S.memories()}
SELECT memory_type, count(*)::BIGINT AS count,
       round(avg(CASE WHEN importance = 1.0 THEN 0.5 ELSE importance END), 9) AS avg_importance
FROM memories GROUP BY memory_type""")
def stream_memories(spark, sf):
    """Memories appended from a stream, scored and embedded per micro-batch; a full
    replay writes nothing twice (ids already stored are skipped)."""
    from glint.sources.memories import read_memories
    path = _stream_memories(spark, sf, 100.0)
    stored = read_memories(spark, path)
    return round_doubles(stored.groupBy("memory_type").agg(
        F.count(F.lit(1)).alias("count"), F.avg("importance").alias("avg_importance")))


@register("maintenance_jobs", f"""WITH {S.memories(500.0)},
g AS (SELECT memory_type, CAST("timestamp" AS DATE) AS date, count(*) AS source_count,
             max(importance) AS importance,
             string_agg('- ' || content || ' (Importance: ' || printf('%.4f', importance) || ')', E'\\n'
                        ORDER BY "timestamp", memory_id) AS txt
      FROM memories GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT memory_type, strftime(date, '%Y-%m-%d') AS date, source_count, round(importance, 9) AS importance,
       length(txt)::BIGINT AS text_length, sha256(txt) AS text_sha256
FROM g""")
def maintenance_jobs(spark, sf):
    """The consolidation job over the memory table that the stream feeds, storing its results there."""
    from glint.sources.memories import read_memories
    path = _stream_memories(spark, sf, 500.0)
    for _ in range(2):                 # the second run finds nothing new
        ST.consolidate_job(spark, path)
    c = read_memories(spark, path).filter(F.col("metadata")["type"] == "consolidated_memory")
    return round_doubles(c.select("memory_type", F.col("metadata")["date"].alias("date"),
                                  F.col("metadata")["source_count"].cast("long").alias("source_count"), "importance",
                                  F.length("content").cast("long").alias("text_length"),
                                  F.sha2("content", 256).alias("text_sha256")))


_LANGS = ["en", "de", "fr", "es"]


@register("index_maintenance", """WITH l AS (
  SELECT * FROM (VALUES (0, 'en'), (1, 'de'), (2, 'fr'), (3, 'es')) t(n, lang)),
s AS (SELECT n, count(doc_id) AS n_docs FROM l LEFT JOIN documents USING (lang) GROUP BY n)
SELECT 'rag_index_v' || n || '.pkl' AS name, TIMESTAMP '2024-01-30 00:00:00' + n * INTERVAL 4 HOUR AS mtime,
       n_docs::BIGINT AS n_docs, n < 2 AS expired FROM s""")
def index_maintenance(spark, sf):
    """The refresh job every four hours (here on the documents of one language after another): what each
    snapshot holds, and which of them the retention of two gives up."""
    docs = B.table(spark, sf, "documents").select("doc_id", "lang", F.col("text").alias("content"))
    base, gone = shared_dir(spark, "snapshots"), None
    start = dt.datetime(2024, 1, 30)
    for n, lang in enumerate(_LANGS):
        gone = ST.refresh_index_job(docs.filter(F.col("lang") == lang), base, f"v{n}", start + dt.timedelta(hours=4 * n), 2)
    log = spark.read.parquet(f"{base}/_log")
    held = None
    for n in range(len(_LANGS)):
        corpus = spark.read.parquet(f"{base}/rag_index_v{n}/corpus").select(
            F.lit(f"rag_index_v{n}.pkl").alias("name"), "n_docs")
        held = corpus if held is None else held.unionByName(corpus)
    gone = gone.select("name", F.lit(True).alias("expired"))
    return (log.select("name", "mtime").join(held, "name").join(gone, "name", "left")
            .withColumn("expired", F.coalesce("expired", F.lit(False))))
