"""TTL cache of the newest row per key as keyed state.

Each key holds one value, its newest row, and one timer. Rows that lie more than the TTL (and the lag that a reader's
clock may have) behind the newest event time are dropped by the watermark, and a key whose row has fallen that
far behind is cleared by its timer, so the state is bounded by the keys that are alive; nothing is written for keys that are not. The cache is read from
the state itself with Spark's state reader, so there is no file per micro-batch to merge.

Before the rows are grouped, each task keeps only the newest row per key of what it reads, and of these only those
that are not already that far behind the task's own newest row: the state is called for keys that can be alive.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from glint.functions.scalar import ntz_micros
from glint.operators.sets import fresh_only

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Newest(StatefulProcessor):
    """The row with the highest (time, tie) of a key; cleared when the watermark passes its time."""

    def __init__(self, schema: str, columns: list[str]):
        self.schema, self.columns = schema, columns          # the time and the tie come first

    def init(self, handle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", self.schema)

    def handleInputRows(self, key, rows, timerValues):
        held = before = self.latest.get() if self.latest.exists() else None
        for pdf in rows:
            top = pdf.sort_values(self.columns[:2], kind="stable", na_position="first").iloc[-1]
            row = tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in top[self.columns])
            if held is None or _order(row) > _order(held):
                held = row
        if held == before:
            return
        for at in self.handle.listTimers():
            self.handle.deleteTimer(at)
        self.latest.update(held)
        self.handle.registerTimer(held[0] // 1000 + 1)
        yield pd.DataFrame([(*key, *held, True)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self.latest.get()
        self.latest.clear()
        yield pd.DataFrame([(*key, *held, False)])

    def close(self) -> None:
        pass


def _order(row: tuple) -> tuple:
    return (row[0], row[1] is not None, row[1] if row[1] is not None else 0)


def _fields(rows: DataFrame, key: str, ts: str, tie: str) -> list[T.StructField]:
    named = {f.name: f for f in rows.schema.fields}
    rest = [f for n, f in named.items() if n not in (key, ts, tie)]
    return [T.StructField("event_micros", T.LongType()), *[T.StructField(f.name, f.dataType) for f in (named[tie], *rest)]]


def combine(key: str, tie: str, horizon: int):
    """Over the Arrow batches of a task: the newest row per key (by ``event_micros``, then ``tie``), without the keys
    whose newest row lies more than ``horizon`` microseconds behind the newest of all."""
    order = [(key, "ascending"), ("event_micros", "ascending"), (tie, "ascending")]

    def newest(t: pa.Table) -> pa.Table:
        t = t.filter(pc.greater_equal(t["event_micros"], pc.subtract(pc.max(t["event_micros"]), horizon)))
        t = t.take(pc.sort_indices(t, sort_keys=order, null_placement="at_start"))
        keys = t[key].combine_chunks()
        last = pc.not_equal(keys[:-1], keys[1:])
        return t.filter(pa.concat_arrays([*(last.chunks if isinstance(last, pa.ChunkedArray) else [last]), pa.array([True])]))

    def run(batches):
        held = None
        for batch in batches:
            if batch.num_rows:
                new = pa.Table.from_batches([batch])
                held = newest(new if held is None else pa.concat_tables([held, new]))
        if held is not None:
            yield from held.to_batches(10_000)
    return run


def newest_per_key(rows: DataFrame, key: str = "symbol", ts: str = "ts", tie: str = "event_id",
                   ttl_seconds: int = 3600, lag_seconds: int = 0) -> DataFrame:
    """Changes of the cache over a stream: ``key, event_micros``, ``tie``, other columns, ``alive`` (false: expired).
    ``lag_seconds``: how far the ``now`` of readers may lie before the newest event."""
    fields = _fields(rows, key, ts, tie)
    schema = T.StructType(fields)
    out = T.StructType([rows.schema[key], *fields, T.StructField("alive", T.BooleanType())])
    d = rows.withColumn("event_micros", ntz_micros(ts)).filter(F.col("event_micros").isNotNull() & F.col(key).isNotNull())
    d = d.select(key, *[f.name for f in fields])
    d = d.mapInArrow(combine(key, tie, (ttl_seconds + lag_seconds + 1) * 1_000_000), d.schema)
    d = d.withColumn("_et", F.timestamp_micros("event_micros")).withWatermark("_et", f"{ttl_seconds + lag_seconds} seconds")
    d = d.select(key, *[f.name for f in fields], "_et")
    return d.groupBy(key).transformWithStateInPandas(
        statefulProcessor=Newest(schema.simpleString()[len("struct<"):-1].replace(":", " "), schema.names),
        outputStructType=out, outputMode="Update", timeMode="EventTime")


def start_cache(rows: DataFrame, checkpoint: str, key: str = "symbol", ts: str = "ts", tie: str = "event_id",
                ttl_seconds: int = 3600, lag_seconds: int = 0, on_change=None):
    """Start the cache over the stream ``rows``; ``on_change(changes, batch_id)`` may pass changes on. Runs until the
    source is read (``availableNow``). Needs a state store with column families, which it sets for this query only."""
    conf = rows.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKS)
    try:
        writer = newest_per_key(rows, key, ts, tie, ttl_seconds, lag_seconds).writeStream.outputMode("update")
        writer = writer.foreachBatch(on_change) if on_change else writer.format("noop")
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if before is None:
            conf.unset(PROVIDER)
        else:
            conf.set(PROVIDER, before)


def read_cache(spark: SparkSession, checkpoint: str, now, ttl_seconds: int = 3600, ts: str = "ts") -> DataFrame:
    """The cached rows younger than the TTL at ``now``, from the state of the last finished micro-batch."""
    held = (spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "latest").load()
            .select("key.*", "value.*"))
    at = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST(event_micros AS DECIMAL(20, 0)) / 1000000)")
    return fresh_only(held.withColumn(ts, at).drop("event_micros"), ts, now, ttl_seconds)
