"""Keyed state over bar streams.

State per symbol is small and bounded: the last accepted time (throttle) or the
last 50 bars (indicators). Rows of one symbol in one micro-batch form one group,
bounded by the trigger size (one file, or ``maxOffsetsPerTrigger``), so a hot
symbol never gathers its whole history in a task.

Late rows: a bar older than the newest bar already in state is not used (it
would change frames already emitted); it is emitted with ``late = true`` and NULL
indicators, or, for the throttle, not accepted.
"""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from glint.functions.scalar import ntz_micros
from glint.session import written

SHORT, LONG = 20, 50

IND_SCHEMA = ("symbol string, timestamp timestamp_ntz, close double, volume double, sma_20 double, "
              "sma_50 double, stddev_20 double, avg_volume_20 double, z_score double, "
              "volume_ratio double, trend string, late boolean")


def _windows(values: np.ndarray, width: int) -> np.ndarray:
    """Row i: the ``width`` values ending at i, NaN-padded before the first row."""
    padded = np.concatenate([np.full(width - 1, np.nan), values])
    return np.lib.stride_tricks.sliding_window_view(padded, width)


def _rolling_mean(values: np.ndarray, width: int) -> np.ndarray:
    return np.nanmean(_windows(values, width), axis=1)


def _frame_mean(values: np.ndarray, width: int) -> np.ndarray:
    """Mean over the known values of each frame (as SQL ``avg``; NaN without any). Values are added from the oldest
    to the newest, so equal frames (the first rows, where sma_20 and sma_50 see the same bars) give equal numbers
    and the trend comparison does not flip on rounding."""
    frames = _windows(values, width)
    total, known = np.zeros(len(values)), np.zeros(len(values))
    for j in range(width):
        here = ~np.isnan(frames[:, j])
        total += np.where(here, frames[:, j], 0.0)
        known += here
    return np.divide(total, known, out=np.full(len(values), np.nan), where=known > 0)


def _rolling_std(values: np.ndarray, width: int) -> np.ndarray:
    w = _windows(values, width)
    n = np.sum(~np.isnan(w), axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        out = np.nanstd(w, axis=1, ddof=1)
    return np.where(n > 1, out, np.nan)


def _indicator_state(key, pdfs, state):
    symbol = key[0]
    if state.exists:
        s_ts, s_close, s_vol = state.get
        s_ts, s_close, s_vol = list(s_ts), list(s_close), list(s_vol)
    else:
        s_ts, s_close, s_vol = [], [], []
    new = pd.concat(list(pdfs), ignore_index=True).sort_values("timestamp", kind="stable")
    newest = s_ts[-1] if s_ts else None
    t_us = new["timestamp"].astype("datetime64[us]").astype("int64").to_numpy()
    late = np.zeros(len(new), dtype=bool) if newest is None else t_us < newest
    fresh = new[~late]
    ts = np.array(s_ts + t_us[~late].tolist(), dtype="int64")
    close = np.array(s_close + fresh["close"].astype(float).tolist())
    vol = np.array(s_vol + fresh["volume"].astype(float).tolist())
    n_old = len(s_ts)
    sma20 = _frame_mean(close, SHORT + 1)[n_old:]
    sma50 = _frame_mean(close, LONG + 1)[n_old:]
    std20 = _rolling_std(close, SHORT + 1)[n_old:]
    avgv = _rolling_mean(vol, SHORT + 1)[n_old:]
    c = close[n_old:]
    v = vol[n_old:]
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.where((std20 > 0) & ~np.isnan(std20), (c - sma20) / std20, np.nan)
        vr = np.where(avgv != 0, v / avgv, np.nan)
    trend = np.where((c > sma20) & (sma20 > sma50), "STRONG_UPTREND",
                     np.where(c > sma20, "UPTREND",
                              np.where((c < sma20) & (sma20 < sma50), "STRONG_DOWNTREND",
                                       np.where(c < sma20, "DOWNTREND", "NEUTRAL"))))
    out = pd.DataFrame({"symbol": symbol, "timestamp": fresh["timestamp"].to_numpy(), "close": c,
                        "volume": v, "sma_20": sma20, "sma_50": sma50, "stddev_20": std20,
                        "avg_volume_20": avgv, "z_score": z, "volume_ratio": vr, "trend": trend,
                        "late": False})
    if late.any():
        lt = new[late]
        out = pd.concat([out, pd.DataFrame({
            "symbol": symbol, "timestamp": lt["timestamp"].to_numpy(), "close": lt["close"].to_numpy(),
            "volume": lt["volume"].to_numpy(), "sma_20": np.nan, "sma_50": np.nan, "stddev_20": np.nan,
            "avg_volume_20": np.nan, "z_score": np.nan, "volume_ratio": np.nan, "trend": None,
            "late": True})], ignore_index=True)
    keep = LONG
    state.update((ts[-keep:].tolist(), close[-keep:].tolist(), vol[-keep:].tolist()))
    yield out


def stream_indicators(bars: DataFrame) -> DataFrame:
    """Indicators of every bar as it arrives, equal to W1-W7 over the same rows in order."""
    return bars.groupBy("symbol").applyInPandasWithState(
        _indicator_state, outputStructType=IND_SCHEMA,
        stateStructType="ts array<long>, close array<double>, volume array<double>",
        outputMode="append", timeoutConf=GroupStateTimeout.NoTimeout)


def _throttle_state(gap_us: int):
    def fn(key, pdfs, state):
        if state.hasTimedOut:
            # The watermark passed last accepted + gap: any later event is accepted
            # whatever the state says, so the state can go.
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(pdfs), ignore_index=True).sort_values(["timestamp", "id"], kind="stable")
        t = rows["timestamp"].astype("datetime64[us]").astype("int64").to_numpy()
        keep = np.zeros(len(t), dtype=bool)
        i = 0 if last is None else int(np.searchsorted(t, last + gap_us, side="left"))
        while i < len(t):
            keep[i] = True
            last = int(t[i])
            i = int(np.searchsorted(t, t[i] + gap_us, side="left"))
        if last is not None:
            state.update((last,))
            # Event-time timeout in ms since the epoch (the event time column is UTC).
            state.setTimeoutTimestamp((last + gap_us) // 1000)
        yield rows[keep][["symbol", "timestamp", "id"]]
    return fn


def stream_throttle(events: DataFrame, gap_seconds: int = 300, delay: str = "10 minutes") -> DataFrame:
    """Accept an event when ``gap`` passed since the last accepted one of its
    symbol; state is that one time per symbol, dropped once the watermark (event time
    minus ``delay``) passes it plus the gap. Rows older than the last accepted one are
    never accepted."""
    ev = (events.withColumn("_et", F.timestamp_micros(ntz_micros("timestamp")))   # zone-free event time
          .withWatermark("_et", delay))
    return ev.groupBy("symbol").applyInPandasWithState(
        _throttle_state(gap_seconds * 1_000_000), outputStructType="symbol string, timestamp timestamp_ntz, id long",
        stateStructType="last long", outputMode="append", timeoutConf=GroupStateTimeout.EventTimeTimeout)


def memories_sink(path: str, **kw):
    """X5 sink for ``foreachBatch``: score, embed and append memories, skipping ids
    already stored, so a replayed micro-batch adds nothing."""
    from glint.operators.models import append_memories

    def run(df: DataFrame, batch_id: int):
        append_memories(df, path, **kw)
    return run


def consolidate_job(spark, memory_path: str, summarizer=None, memory_type: str | None = None) -> None:
    """Run-once consolidation of the memory table; the schedule belongs to the caller. The consolidated memories
    are stored in the same table, marked in their metadata, and are not consolidated again; a second run over the
    same memories stores nothing."""
    from glint.operators.memory import consolidate
    from glint.operators.models import append_memories
    from glint.sources.memories import read_memories
    c = consolidate(read_memories(spark, memory_path), summarizer, memory_type=memory_type)
    rows = c.select(F.lit(None).cast("long").alias("memory_id"), "memory_type", "content", "timestamp", "importance",
                    "metadata", F.lit(None).cast("string").alias("context"),
                    F.lit(None).cast("array<string>").alias("emotions"))
    append_memories(written(rows, "consolidated"), memory_path)


def refresh_index_job(docs: DataFrame, base: str, version: str, mtime: dt.datetime, keep: int = 5):
    """Rebuild the BM25 index, save it as a snapshot of time ``mtime``, and list snapshots beyond
    the newest ``keep`` (W10) for the caller to delete."""
    from glint.operators.history import retention
    from glint.sources.index_store import build_snapshot
    spark = docs.sparkSession
    build_snapshot(docs, base, version, mtime)
    log = spark.read.parquet(f"{base.rstrip('/')}/_log")
    return retention(log, keep=keep)

