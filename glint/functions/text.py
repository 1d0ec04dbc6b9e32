"""Text column functions (all JVM-side built-ins, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: one token is a run of letters/digits, or one other non-blank character.
TOKEN_PATTERN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize(col) -> Column:
    """Lower-case, then words and single punctuation marks as tokens (V1)."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(TOKEN_PATTERN), 0)


def truncate_tokens(col, n: int = 512) -> Column:
    """First ``n`` tokens (V9)."""
    return F.slice(_c(col), 1, n)


def clip(col, n: int) -> Column:
    """First ``n`` characters plus '...', always added."""
    return F.concat(F.substring(_c(col), 1, n), F.lit("..."))


def fmt_fixed(col, places: int = 2) -> Column:
    """Number to text with ``places`` decimals, rounded like Python's ``f"{x:.2f}"``.

    Java's formatter rounds the shortest decimal form half up (0.975 -> '0.98');
    Python and C round the exact binary value (0.975 is 0.97499.. -> '0.97').
    Here ``|x| * 10**places`` is split exactly into ``p + err`` (Dekker's product,
    plain double arithmetic), so the rounding sees the exact value; exact ties go
    to even. All built-in column arithmetic, no UDF.
    """
    x = _c(col).cast("double")
    scale = float(10 ** places)
    a = F.abs(x)
    p = a * F.lit(scale)
    c = a * F.lit(134217729.0)
    hi = c - (c - a)
    lo = a - hi
    err = (hi * F.lit(scale) - p) + lo * F.lit(scale)
    fl = F.floor(p)
    fr = p - fl
    q = (F.when(fr > 0.5, fl + 1).when(fr < 0.5, fl)
         .when(err > 0, fl + 1).when(err < 0, fl)
         .otherwise(fl + F.pmod(fl, F.lit(2))))
    unit = 10 ** places
    frac = F.lpad(F.pmod(q, F.lit(unit)).cast("string"), places, "0")
    whole = ((q - F.pmod(q, F.lit(unit))) / F.lit(unit)).cast("long").cast("string")
    body = F.concat(whole, F.lit("."), frac) if places > 0 else whole
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    return (F.when(x.isNull(), F.lit(None).cast("string"))
            .when(F.isnan(x), F.lit("nan"))
            .when(a == F.lit(float("inf")), F.concat(sign, F.lit("inf")))
            .otherwise(F.concat(sign, body)))


def fmt2(col) -> Column:
    """Number to text with 2 decimals (V17), rounded like the reference's Python."""
    return fmt_fixed(col, 2)


def split_sentiment(col) -> Column:
    """'a, b, c' -> ['a', 'b', 'c']."""
    return F.split(_c(col), ", ")


def session_label(ts) -> Column:
    """Trading session of a timestamp: hours 9..16 inclusive."""
    return F.when(F.hour(_c(ts)).between(9, 16), F.lit("Normal Trading Hours")) \
        .otherwise(F.lit("Extended Hours"))


def ts_text(ts) -> Column:
    """'YYYY-MM-DD HH:MM:SS' (V15)."""
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss")


def market_context_text(now) -> Column:
    """Context block of an enriched query, from a time column (never the wall clock)."""
    return F.concat(F.lit("Market Context: - Current Time: "), ts_text(now),
                    F.lit(" - Trading Session: "), session_label(now))


def enhance_query(query, symbol, now, start=None, end=None) -> Column:
    """Enriched query text (V18): context, symbol or 'N/A', query, optional period."""
    base = F.concat(F.lit("Context: "), market_context_text(now),
                    F.lit("\nSymbol: "), F.coalesce(_c(symbol), F.lit("N/A")),
                    F.lit("\nQuery: "), _c(query))
    if start is None:
        return base
    period = F.concat(F.lit("\nTime period: "), ts_text(start), F.lit(" to "), ts_text(end))
    return F.concat(base, F.coalesce(period, F.lit("")))


def collect_text(item: Column, *order: Column, sep: str = "\n") -> Column:
    """Aggregate: join formatted items by ``sep`` in the given order.

    Sorting a collected array of structs keeps the order deterministic; the
    aggregate is partial + final, so no single task sees raw input rows of a hot key.
    """
    s = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], item.alias("item"))
    return F.array_join(F.transform(F.array_sort(F.collect_list(s)), lambda x: x["item"]), sep)
