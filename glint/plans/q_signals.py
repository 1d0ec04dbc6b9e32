"""Queries over bars: scan, filters, newest rows, indicators, context."""

from __future__ import annotations

from glint.functions.text import session_label
from glint.operators import signals
from glint.operators.sets import filter_symbols, filter_watchlist
from glint.plans import bindings as B
from glint.plans import sqlbind as S
from glint.plans.catalog import register, round_doubles



@register("bar_scan", f"""WITH {S.BARS_EVT}
SELECT symbol, "timestamp", round(close, 9) AS close, round(volume, 9) AS volume FROM bars""")
def bar_scan(spark, sf):
    return round_doubles(B.bars(spark, sf))


@register("newest_bars", f"""WITH {S.BARS_EVT}
SELECT symbol, "timestamp", round(close, 9) AS close, round(volume, 9) AS volume FROM bars
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY "timestamp" DESC) <= 1000""")
def newest_bars(spark, sf):
    return round_doubles(signals.newest_bars(B.bars(spark, sf), 1000))


@register("symbol_filter", f"""WITH {S.BARS_EVT}
SELECT symbol, "timestamp", round(close, 9) AS close, round(volume, 9) AS volume FROM bars
WHERE symbol IN ('purchase', 'view')""")
def symbol_filter(spark, sf):
    return round_doubles(filter_symbols(B.bars(spark, sf), ["purchase", "view"]))


@register("watchlist_filter", f"""WITH {S.BARS_USR}, {S.WATCHLIST}
SELECT symbol, "timestamp", round(close, 9) AS close, round(volume, 9) AS volume FROM bars
WHERE symbol IN (SELECT symbol FROM watchlist)""")
def watchlist_filter(spark, sf):
    return round_doubles(filter_watchlist(B.bars(spark, sf, "user_id"), B.watchlist(spark, sf)))


@register("indicators", f"""WITH {S.BARS_EVT},
nb AS (SELECT * FROM bars
       QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY "timestamp" DESC) <= 1000),
{S.indicator_select('nb')}
SELECT {S.IND_COLS} FROM ind""")
def indicators(spark, sf):
    """The reference's computation: indicators over the newest 1000 bars of each symbol."""
    return round_doubles(signals.indicators(signals.newest_bars(B.bars(spark, sf), 1000)))


@register("indicators_history", f"""WITH {S.BARS_USR},
{S.indicator_select('bars')}
SELECT {S.IND_COLS} FROM ind""")
def indicators_history(spark, sf):
    """Indicators over the whole history, every symbol cut into ordered pieces with a halo."""
    return round_doubles(signals.indicators(B.bars(spark, sf, "user_id"), split=True))


@register("indicators_history_hot", f"""WITH {S.BARS_EVT},
{S.indicator_select('bars')}
SELECT {S.IND_COLS} FROM ind""")
def indicators_history_hot(spark, sf):
    """Same, with five long series (each a fifth of all rows), in pieces of 500 rows."""
    return round_doubles(signals.indicators(B.bars(spark, sf), split=True, rows_per_piece=500))


@register("latest_indicators", f"""WITH {S.BARS_EVT},
nb AS (SELECT * FROM bars
       QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY "timestamp" DESC) <= 1000),
{S.indicator_select('nb')}
SELECT {S.IND_COLS} FROM ind
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY "timestamp" DESC) = 1""")
def latest_indicators(spark, sf):
    return round_doubles(signals.latest_indicators(B.bars(spark, sf), 1000))


MARKET_CONTEXT_SQL = f"""WITH {S.BARS_USR},
nb AS (SELECT * FROM bars
       QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY "timestamp" DESC) <= 1000),
{S.indicator_select('nb')},
latest AS (SELECT * FROM ind
           QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY "timestamp" DESC) = 1)
SELECT {S.IND_COLS}, {S.CONTEXT_COLS} FROM latest"""


@register("market_context", MARKET_CONTEXT_SQL)
def market_context(spark, sf):
    """Flagship: latest indicators and market context of every symbol in one job."""
    return round_doubles(signals.market_context(
        signals.latest_indicators(B.bars(spark, sf, "user_id"), 1000)))


@register("session_label", f"""WITH {S.BARS_EVT}
SELECT symbol, "timestamp",
  CASE WHEN hour("timestamp") BETWEEN 9 AND 16 THEN 'Normal Trading Hours' ELSE 'Extended Hours' END
    AS session
FROM bars""")
def session_label_q(spark, sf):
    return B.bars(spark, sf).select("symbol", "timestamp", session_label("timestamp").alias("session"))
