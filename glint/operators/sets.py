"""Symbol filters and watchlist set operations.

No broadcast hints here: the watchlist is data, so its size is not proven. With
AQE on, Spark turns the semi join into a broadcast at run time when the watchlist
stage is measured below ``spark.sql.adaptive.autoBroadcastJoinThreshold``, and
keeps the shuffled join otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_symbols(df: DataFrame, symbols: list[str]) -> DataFrame:
    """Rows of the given symbols; a literal list, pushed to the scan (F1)."""
    return df.filter(F.col("symbol").isin(list(symbols)))


def filter_watchlist(df: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Rows whose symbol is monitored (F2)."""
    return df.join(watchlist.select("symbol"), "symbol", "left_semi")


def watchlist_add(watchlist: DataFrame, symbols: DataFrame) -> DataFrame:
    """Set union (O3)."""
    return watchlist.select("symbol").unionByName(symbols.select("symbol")).distinct()


def watchlist_remove(watchlist: DataFrame, symbols: DataFrame) -> DataFrame:
    """Set difference."""
    return watchlist.select("symbol").distinct().join(symbols.select("symbol"), "symbol", "left_anti")


def due_symbols(watchlist: DataFrame, last_run: DataFrame, now, gap_seconds: int = 300) -> DataFrame:
    """Monitored symbols not analysed within ``gap_seconds`` before ``now``.

    ``last_run``: ``symbol, last_analysis``; ``now`` is a literal or a column.
    """
    now_c = F.lit(now).cast("timestamp_ntz") if isinstance(now, str) else now
    j = watchlist.select("symbol").join(last_run.select("symbol", "last_analysis"), "symbol", "left")
    return j.filter(F.col("last_analysis").isNull()
                    | (F.col("last_analysis") <= now_c - F.make_dt_interval(secs=F.lit(gap_seconds))))


def fresh_only(df: DataFrame, ts: str, now, ttl_seconds: int = 3600) -> DataFrame:
    """Rows younger than the TTL at ``now``."""
    now_c = F.lit(now).cast("timestamp_ntz") if isinstance(now, str) else now
    return df.filter(F.col(ts) > now_c - F.make_dt_interval(secs=F.lit(ttl_seconds)))
