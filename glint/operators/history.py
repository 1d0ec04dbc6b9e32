"""Time-ordered per-key operators: as-of join, retention, latest per key, throttle.

(J9, W10, W11, S8, T7, S9.)

Skew: a window partitioned by key alone puts a hot key in one task. The scans
here are partitioned by (key, time chunk) and receive a *carry-in* from earlier
chunks, computed on a small per-chunk table, so one key with a third of all
rows still spreads over as many tasks as it has chunks, with the same result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glint.functions.scalar import ntz_micros

DAY = 86_400
CUTS_AT_ONCE = 64           # cuts of a key that a row is compared with at once


def chunk_of(ts: str, chunk_seconds: int):
    micros = ntz_micros(ts)
    return F.floor(micros / F.lit(chunk_seconds * 1_000_000)).cast("long")


def with_chunks(df: DataFrame, key: str, ts: str, chunk_seconds: int | None,
                rows_per_chunk: int = 1_000_000, min_seconds: int = 1, out: str = "_c") -> DataFrame:
    """Add a time-chunk number per row. Fixed length when ``chunk_seconds`` is given;
    otherwise each key gets a length holding about ``rows_per_chunk`` of its rows
    (from a one-row-per-key table, joined by a size-checked broadcast, so the rows of
    a hot key are not shuffled by key for it). Adds ``_cu``, the length in micros."""
    from glint.operators.text_index import bounded_broadcast
    t = ntz_micros(ts)
    if chunk_seconds is not None:
        df = df.withColumn("_cu", F.lit(chunk_seconds * 1_000_000).cast("long"))
    else:
        per_key = (df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"),
                                       (F.max(t) - F.min(t) + 1).alias("_span"))
                   .select(key, F.greatest(F.lit(min_seconds * 1_000_000),
                                           F.ceil(F.col("_span") * F.lit(rows_per_chunk) / F.col("_n")))
                           .cast("long").alias("_cu")))
        df = df.join(bounded_broadcast(per_key), key)
    return df.withColumn(out, F.floor(t / F.col("_cu")).cast("long"))


def with_pieces(df: DataFrame, key: str, ts: str, rows_per_piece: int = 1_000_000, out: str = "_c") -> DataFrame:
    """Add ``out``, the ordered piece of its key that a row belongs to: pieces are cut at quantiles of the key's times,
    so a burst is split by rows and not by time. Rows of equal time share a piece.

    One scan counts the rows per key; only keys with more than one piece are scanned again for their cuts (a sketch
    per key, merged from partial ones). The cuts join by a size-checked broadcast.
    """
    from glint.operators.text_index import bounded_broadcast
    t = ntz_micros(ts)
    big = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_piece)
    big = big.withColumn("_parts", F.ceil(F.col("_n") / F.lit(rows_per_piece)).cast("int")).select(key, "_parts")
    most = big.agg(F.max("_parts")).first()[0]
    if most is None:
        return df.withColumn(out, F.lit(0).cast("long"))
    cuts = (df.join(bounded_broadcast(big), key).groupBy(key).agg(
        F.first("_parts").alias("_parts"),
        F.percentile_approx(t, [i / most for i in range(1, most)], max(10_000, 20 * most)).alias("_q")))
    # of the quantiles taken for the largest key, every key uses as many as it has pieces
    some = F.transform(F.sequence(F.lit(1), F.greatest(F.col("_parts") - 1, F.lit(1))),
                       lambda i: F.get("_q", F.floor(i * F.lit(most) / F.col("_parts")).cast("int") - 1))
    cuts = cuts.select(key, F.array_sort(F.array_distinct(some)).alias("_cuts"))
    d = df.withColumn("_at", t)
    if most <= CUTS_AT_ONCE:
        d = d.join(bounded_broadcast(cuts), key, "left")
        return d.withColumn(out, F.coalesce(_below("_cuts", most), F.lit(0)).cast("long")).drop("_cuts", "_at")
    # Many cuts: a row carries only every width-th cut, then the width cuts of its own group.
    width = math.isqrt(most - 1) + 1
    groups = F.sequence(F.lit(0), F.floor(F.size("_cuts") / F.lit(width)).cast("int"))
    fine = cuts.select(key, F.posexplode(F.transform(groups, lambda g: F.slice("_cuts", g * width + 1, width))).alias("_g", "_fine"))
    coarse = cuts.select(key, F.filter("_cuts", lambda c, i: (i + 1) % width == 0).alias("_coarse"))
    d = d.join(bounded_broadcast(coarse), key, "left").withColumn("_g", F.coalesce(_below("_coarse", width), F.lit(0))).drop("_coarse")
    d = d.join(bounded_broadcast(fine), [key, "_g"], "left")
    piece = F.col("_g").cast("long") * width + F.coalesce(_below("_fine", width), F.lit(0))
    return d.withColumn(out, piece.cast("long")).drop("_g", "_fine", "_at")


def _below(cuts: str, most: int) -> Column:
    """How many of the sorted ``cuts`` (at most ``most``) lie before ``_at``, by halving steps; NULL without cuts."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(most, 1).bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.get(cuts, at + step - 1) < F.col("_at"), at + step).otherwise(at))
    return F.when(F.col(cuts).isNotNull(), found)


def asof_join(left: DataFrame, right: DataFrame, key: str = "symbol", ts: str = "timestamp",
              right_ts: str = "timestamp", rows_per_piece: int = 1_000_000, tie: str | None = None) -> DataFrame:
    """For each left row, the last right row of the same key at or before its time.

    Left rows keep all columns; right columns are added as ``right`` (a struct, NULL
    when nothing precedes). A right row sorts before a left row at equal time; of right rows of
    equal time the one with the highest ``tie`` column (or else the highest row) counts.

    Both sides are shuffled once, by key and ordered piece (``with_pieces``). A piece hands its last right
    row on to the later pieces of its key through a table of one row per piece.
    """
    r = right.select(F.col(key).alias("_k"), F.col(right_ts).alias("_t"), F.struct(*right.columns).alias("_r"),
                     F.lit(0).alias("_side"))
    l_ = left.select(F.col(key).alias("_k"), F.col(ts).alias("_t"), F.struct(*left.columns).alias("_l"),
                     F.lit(1).alias("_side"))
    u = with_pieces(r.unionByName(l_, allowMissingColumns=True), "_k", "_t", rows_per_piece)
    last = F.col(f"_r.{tie}") if tie else F.col("_r")
    w = Window.partitionBy("_k", "_c").orderBy("_t", "_side", last) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    u = u.withColumn("_in", F.last("_r", ignorenulls=True).over(w))
    # What a piece hands on: the right row that its last row sees (no shuffle: same partitioning).
    end = F.max_by("_in", F.struct("_t", "_side", last.alias("_o")))
    handed = u.groupBy("_k", "_c").agg(end.alias("_lr"))
    wc = Window.partitionBy("_k").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carry = handed.withColumn("_carry", F.last("_lr", ignorenulls=True).over(wc)).select("_k", "_c", "_carry")
    return (u.filter(F.col("_side") == 1).join(carry, ["_k", "_c"], "left")
            .select("_l.*", F.coalesce("_in", "_carry").alias("right")))


def retention(log: DataFrame, keep: int = 5, pattern: str = r"^rag_index_.*\.pkl$") -> DataFrame:
    """Snapshots to delete: all but the newest ``keep`` per series.

    Newest by ``mtime`` desc, ties by ``name``. The kept set is a per-series
    group limit (partial before the shuffle), and the rest is an anti join on
    (series, name), so a series holding a third of the log still spreads by name.
    """
    c = log.filter(F.col("name").rlike(pattern))
    w = Window.partitionBy("series").orderBy(F.col("mtime").desc(), F.col("name"))
    kept = c.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= keep).select("series", "name")
    return c.join(kept, ["series", "name"], "left_anti")


def latest_snapshot(log: DataFrame, pattern: str = r"^rag_index_.*\.pkl$") -> DataFrame:
    """Newest snapshot per series (S8), ties by smallest name; a partial aggregate."""
    c = log.filter(F.col("name").rlike(pattern))
    order = F.struct((-ntz_micros("mtime")).alias("a"), F.col("name").alias("b"))
    return (c.groupBy("series")
            .agg(F.min_by(F.struct("name", "path", "mtime"), order).alias("s"))
            .select("series", "s.name", "s.path", "s.mtime"))


def latest_per_key(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Newest row per key (T7), ties by largest ``tie``; partial + final aggregate."""
    cols = [c for c in df.columns if c != key]
    return (df.groupBy(key)
            .agg(F.max_by(F.struct(*cols), F.struct(ts, tie)).alias("s"))
            .select(key, "s.*"))


def _chunk_walk(t: np.ndarray, start: int, gap_us: int, memo: dict) -> int:
    """Exit state (last accepted time + gap) of the greedy chain from index ``start``
    within one chunk; chains that meet share the memoised rest."""
    path, k = [], start
    while k < len(t) and k not in memo:
        path.append(k)
        k = int(np.searchsorted(t, t[k] + gap_us, side="left"))
    end = memo[k] if k < len(t) else int(t[path[-1]]) + gap_us
    for p in path:
        memo[p] = end
    return end


def _throttle_summary(pdf: pd.DataFrame, gap_us: int) -> pd.DataFrame:
    """Stage 1, per (key, chunk): the chunk's transfer function. Its possible first
    accepted rows are the rows of its first ``gap`` and the first row after; each gets
    the chunk's exit state (last accepted + gap). Consecutive candidates with the same
    exit form one segment ``(_hi = last candidate time, _exit)``; chains usually merge,
    so a chunk has few segments whatever its size."""
    pdf = pdf.sort_values(["_t", "_id"], kind="stable")
    t = pdf["_t"].to_numpy(dtype="int64")
    c = int(pdf["_c"].iloc[0])
    cs = c * int(pdf["_cu"].iloc[0])
    last_cand = int(np.searchsorted(t, cs + gap_us, side="left"))
    cands = list(range(0, min(last_cand + 1, len(t))))
    memo: dict = {}
    exits = np.asarray([_chunk_walk(t, i, gap_us, memo) for i in reversed(cands)][::-1], dtype="int64")
    ends = np.flatnonzero(np.r_[exits[1:] != exits[:-1], True])      # last candidate of each run
    return pd.DataFrame({"_c": c, "_hi": t[cands][ends], "_exit": exits[ends],
                         "_cu": int(pdf["_cu"].iloc[0])})


def _throttle_entries(pdf: pd.DataFrame) -> pd.DataFrame:
    """Stage 2, per key, over the segments: the threshold entering each chunk that
    accepts something (NULL: the chunk's first row is accepted)."""
    pdf = pdf.sort_values(["_c", "_hi"], kind="stable")
    theta = None
    out_c, out_th = [], []
    for c, g in pdf.groupby("_c", sort=True):
        hi = g["_hi"].to_numpy(dtype="int64")
        i = 0 if theta is None else int(np.searchsorted(hi, theta, side="left"))
        if i < len(hi):
            out_c.append(c)
            out_th.append(theta)
            theta = int(g["_exit"].to_numpy()[i])
    return pd.DataFrame({"_c": np.asarray(out_c, dtype="int64"),
                         "_theta": pd.array(out_th, dtype="Int64")})


def _throttle_accept(pdf: pd.DataFrame, gap_us: int) -> pd.DataFrame:
    """Stage 3, per (key, chunk): the chain from the first row at or after the threshold."""
    pdf = pdf.sort_values(["_t", "_id"], kind="stable")
    t = pdf["_t"].to_numpy(dtype="int64")
    keep = np.zeros(len(t), dtype=bool)
    theta = pdf["_theta"].iloc[0]
    i = 0 if pd.isna(theta) else int(np.searchsorted(t, int(theta), side="left"))
    while i < len(t):
        keep[i] = True
        i = int(np.searchsorted(t, t[i] + gap_us, side="left"))
    return pdf[keep][["_id"]]


def throttle(events: DataFrame, key: str = "symbol", ts: str = "timestamp", id_col: str = "id",
             gap_seconds: int = 300, chunk_seconds: int | None = None,
             rows_per_chunk: int = 1_000_000) -> DataFrame:
    """Greedy throttle (W11): accept a row if at least ``gap`` passed since the last
    *accepted* row of its key. Returns the accepted rows.

    The rule is sequential, but within a time chunk only the chunk's first ``gap``
    can hold its first accepted row. So, with every group bounded by one (key, chunk):
      1. per (key, chunk), each possible entry row gets the chunk's exit state
         (last accepted + gap) by a memoised greedy walk, kept as segments of equal exit;
      2. per key, a pass over the segments (a few for each chunk of ``rows_per_chunk`` rows, 24 bytes each)
         gives the threshold entering each chunk;
      3. per (key, chunk), the chain from the first row at or after it gives the
         accepted rows.
    Chunk length is chosen per key so that a chunk holds about ``rows_per_chunk`` rows
    (never under twice the gap), from a one-row-per-key table joined by a size-checked
    broadcast; ``chunk_seconds`` fixes it instead. A key with a third of all rows, even
    without any pause, is spread over its chunks.
    """
    gap_us = gap_seconds * 1_000_000
    e = events.select(F.col(key).alias("symbol"), F.col(ts).alias("_ts"), F.col(id_col).alias("_id")) \
        .withColumn("_t", ntz_micros("_ts"))
    e = with_chunks(e, "symbol", "_ts", chunk_seconds, rows_per_chunk, min_seconds=2 * gap_seconds) \
        .select("symbol", "_c", "_cu", "_t", "_id")
    summary = e.groupBy("symbol", "_c").applyInPandas(
        lambda pdf: _throttle_summary(pdf, gap_us).assign(symbol=pdf["symbol"].iloc[0]),
        schema="_c long, _hi long, _exit long, _cu long, symbol string")
    entries = summary.groupBy("symbol").applyInPandas(
        lambda pdf: _throttle_entries(pdf).assign(symbol=pdf["symbol"].iloc[0]),
        schema="_c long, _theta long, symbol string")
    tagged = e.join(entries, ["symbol", "_c"], "inner")   # a chunk without an entry accepts nothing
    acc = tagged.groupBy("symbol", "_c").applyInPandas(
        lambda pdf: _throttle_accept(pdf, gap_us), schema="_id long")
    return events.join(acc.withColumnRenamed("_id", id_col), id_col, "left_semi")
