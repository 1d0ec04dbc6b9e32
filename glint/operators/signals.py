"""Rolling technical indicators and market context per symbol.

Bars: ``symbol string, timestamp timestamp_ntz, close double, volume double``.

Two physical shapes for the same result:

* ``indicators(bars)`` partitions the window by symbol. Right when each symbol is
  bounded, e.g. after ``newest_bars`` (at most ``n`` rows per symbol reach the
  window, and the per-partition group limit runs before the shuffle).
* ``indicators(bars, split=True)`` cuts every symbol into ordered pieces of about equal rows and
  gives each piece an exact halo: the last 50 rows before it, however many earlier
  pieces they span. A symbol holding a third of all rows is then spread over many
  tasks; the result is identical.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glint.session import written

BAR_COLS = ["symbol", "timestamp", "close", "volume"]

# Trend labels in evaluation order and their strength.
TREND_STRENGTH = {
    "STRONG_UPTREND": 1.0,
    "UPTREND": 0.5,
    "NEUTRAL": 0.0,
    "DOWNTREND": -0.5,
    "STRONG_DOWNTREND": -1.0,
}


def newest_bars(bars: DataFrame, n: int = 1000) -> DataFrame:
    """Newest ``n`` bars of each symbol.

    ``row_number <= n`` is planned as a partial group limit before the shuffle, so a
    hot symbol ships at most ``n`` rows per input partition.
    """
    w = Window.partitionBy("symbol").orderBy(*_order(bars, newest_first=True))
    return bars.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def _order(bars: DataFrame, newest_first: bool = False) -> list:
    """Time, then an id if the bars have one, then the values: rows of equal time have one order everywhere."""
    cols = [F.col(c) for c in ("timestamp", "id", "close", "volume") if c in bars.columns]
    return [c.desc() for c in cols] if newest_first else cols


def _with_indicators(df: DataFrame, part: list[str], short: int, long: int) -> DataFrame:
    w = Window.partitionBy(*part).orderBy(*_order(df))
    ws, wl = w.rowsBetween(-short, 0), w.rowsBetween(-long, 0)
    close, sma20, sma50 = F.col("close"), F.col("sma_20"), F.col("sma_50")
    out = (df
           .withColumn("sma_20", F.avg("close").over(ws))
           .withColumn("sma_50", F.avg("close").over(wl))
           .withColumn("stddev_20", F.stddev_samp("close").over(ws))
           .withColumn("avg_volume_20", F.avg("volume").over(ws)))
    return (out
            .withColumn("z_score", F.try_divide(close - sma20, F.col("stddev_20")))
            .withColumn("volume_ratio", F.try_divide(F.col("volume"), F.col("avg_volume_20")))
            .withColumn("trend",
                        F.when((close > sma20) & (sma20 > sma50), "STRONG_UPTREND")
                        .when(close > sma20, "UPTREND")
                        .when((close < sma20) & (sma20 < sma50), "STRONG_DOWNTREND")
                        .when(close < sma20, "DOWNTREND")
                        .otherwise("NEUTRAL")))


def piece_windows(bars: DataFrame, short: int, long: int, pieces: DataFrame) -> DataFrame:
    """Indicators over symbols that are cut into ordered pieces (``pieces``: bars with column ``_piece``).

    The bars are shuffled once, by symbol and piece. A row with at least ``halo`` rows of its piece before it has its
    whole frames there. The first and last ``halo`` rows of every piece (written once, a small table) give
    the others theirs: the first rows of a piece are windowed again after the last rows before the piece, however many
    pieces these span.
    """
    halo = max(short, long)
    w = Window.partitionBy("symbol", "_piece").orderBy(*_order(bars))
    b = (_with_indicators(pieces, ["symbol", "_piece"], short, long)
         .withColumn("_rn", F.row_number().over(w))
         .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("symbol", "_piece"))))
    edges = written(b.filter((F.col("_rn") <= halo) | (F.col("_rn") > F.col("_n") - halo)).select(
        *bars.columns, "_piece", "_rn", "_n"), "piece-edges")
    ws = Window.partitionBy("symbol").orderBy("_piece")
    counts = (edges.filter(F.col("_rn") == 1).select("symbol", "_piece", "_n")
              .withColumn("_idx", F.row_number().over(ws))
              .withColumn("_upto", F.sum("_n").over(ws.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("_last", F.max("_idx").over(Window.partitionBy("symbol")))
              .withColumn("_reach", F.count(F.lit(1)).over(     # how many pieces on this one's rows can be needed
                  Window.partitionBy("symbol").orderBy("_upto").rangeBetween(0, max(halo - 1, 0)))))
    tails = (edges.filter(F.col("_rn") > F.col("_n") - halo).withColumn("_back", F.col("_n") - F.col("_rn") + 1).drop("_n")
             .join(counts, ["symbol", "_piece"]).filter(F.col("_idx") < F.col("_last"))
             .withColumn("_to", F.explode(F.sequence(F.col("_idx") + 1, F.least(F.col("_idx") + F.col("_reach"), F.col("_last"))))))
    targets = counts.select("symbol", F.col("_idx").alias("_to"), F.col("_piece").alias("_target"),
                            (F.col("_upto") - F.col("_n")).alias("_before"))
    before = (tails.join(targets, ["symbol", "_to"]).filter(F.col("_back") + F.col("_before") - F.col("_upto") <= halo)
              .select(*bars.columns, F.col("_target").alias("_piece"), F.lit(False).alias("_own")))
    heads = edges.filter(F.col("_rn") <= halo).select(*bars.columns, "_piece", F.lit(True).alias("_own"))
    again = _with_indicators(heads.unionByName(before), ["symbol", "_piece"], short, long).filter("_own")
    cols = [c for c in again.columns if c not in ("_piece", "_own")]
    return b.filter(F.col("_rn") > halo).select(*cols).unionByName(again.select(*cols))


def indicators(bars: DataFrame, short: int = 20, long: int = 50,
               chunk_seconds: int | None = None, split: bool | None = None,
               rows_per_piece: int = 1_000_000) -> DataFrame:
    """sma_20 over ``short``+1 rows, sma_50 over ``long``+1 rows (the
    reference's frames include the current row), sample stddev, average volume,
    z-score and volume ratio (NULL on a zero or NULL divisor), trend label.
    Bars of equal time are ordered by an ``id`` column, if there is one, then by close and volume.

    ``split=True`` cuts every symbol into ordered pieces of about ``rows_per_piece`` rows; ``chunk_seconds`` cuts by
    time instead."""
    from glint.operators.history import with_chunks, with_pieces
    bars = bars.select(*BAR_COLS, *[c for c in bars.columns if c == "id"])
    if not (split or chunk_seconds is not None):
        out = _with_indicators(bars, ["symbol"], short, long)
    elif chunk_seconds is not None:
        pieces = with_chunks(bars, "symbol", "timestamp", chunk_seconds, out="_piece").drop("_cu")
        out = piece_windows(bars, short, long, pieces)
    else:
        out = piece_windows(bars, short, long, with_pieces(bars, "symbol", "timestamp", rows_per_piece, "_piece"))
    return out.drop("id")


def latest_per_symbol(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Newest row per symbol (W9); a symbol without rows gives no row."""
    order = _order(df, newest_first=True) if ts == "timestamp" else [F.col(ts).desc()]
    w = Window.partitionBy("symbol").orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def latest_indicators(bars: DataFrame, n: int = 1000) -> DataFrame:
    """Newest ``n`` bars -> indicators -> newest row, all on one partitioning by symbol."""
    return latest_per_symbol(indicators(newest_bars(bars, n)))


def market_context(ind: DataFrame) -> DataFrame:
    """C1-C4 appended as four columns. NULL z-score means LOW, NULL ratio NORMAL."""
    strength = F.create_map(*[x for k, v in TREND_STRENGTH.items() for x in (F.lit(k), F.lit(v))])
    z, vr, close, sma = F.abs(F.col("z_score")), F.col("volume_ratio"), F.col("close"), F.col("sma_20")
    return (ind
            .withColumn("trend_strength", strength[F.col("trend")])
            .withColumn("volatility_level",
                        F.when(z > 2.0, "HIGH").when(z > 1.0, "MEDIUM").otherwise("LOW"))
            .withColumn("volume_signal",
                        F.when(vr > 2.0, "VERY_HIGH").when(vr > 1.5, "HIGH")
                        .when(vr < 0.5, "LOW").otherwise("NORMAL"))
            .withColumn("price_momentum",
                        F.when(close > sma * 1.05, "STRONG_POSITIVE")
                        .when(close < sma * 0.95, "STRONG_NEGATIVE")
                        .when(close > sma, "POSITIVE")
                        .when(close < sma, "NEGATIVE")
                        .otherwise("NEUTRAL")))
