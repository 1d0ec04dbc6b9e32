"""Scores, metadata maps, JSON and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metadata keys the memory store reserves for itself.
RESERVED_KEYS = ["importance", "timestamp", "context", "emotions"]

# Fallbacks of the reference when a step fails.
DEFAULT_IMPORTANCE = 0.5
DEFAULT_RERANK = 0.0
NO_INSIGHTS = "No highly relevant historical insights found."
ERROR_DECISION = "Error analyzing trading opportunity"
ERROR_SENTIMENT = "uncertain"
NOT_SCORED = 1.0


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp01(col) -> Column:
    """Clamp to [0, 1]; NULL stays NULL (``least``/``greatest`` would skip it)."""
    x = _c(col).cast("double")
    return F.when(x.isNull(), F.lit(None).cast("double")) \
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def parse_score(col, default: float = DEFAULT_IMPORTANCE) -> Column:
    """Float from model text, trimmed and clamped; default when it does not parse."""
    text = F.trim(_c(col))
    plain = text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")     # not "1d", which a cast accepts
    return F.coalesce(F.when(plain, clamp01(text.try_cast("double"))), F.lit(default))


def resolve_importance(importance, scored) -> Column:
    """Importance exactly 1.0 means 'not scored yet': take the scored value."""
    return F.when(_c(importance) == F.lit(NOT_SCORED), _c(scored)).otherwise(_c(importance))


def strip_reserved(meta) -> Column:
    """Drop the store's reserved keys from a metadata map."""
    keys = F.array(*[F.lit(k) for k in RESERVED_KEYS])
    return F.map_filter(_c(meta), lambda k, v: ~F.array_contains(keys, k))


def merge_metadata(caller, computed) -> Column:
    """Caller metadata merged with computed keys; computed keys win.

    Written without the session-wide ``mapKeyDedupPolicy`` switch: the caller's
    colliding keys are dropped first.
    """
    comp = _c(computed)
    left = F.map_filter(_c(caller), lambda k, v: ~F.array_contains(F.map_keys(comp), k))
    return F.map_concat(left, comp)


def map_keys_text(meta) -> Column:
    """Sorted keys joined by ',' (a stable, comparable view of a map)."""
    return F.array_join(F.array_sort(F.map_keys(_c(meta))), ",")


def day(ts) -> Column:
    return F.to_date(_c(ts))


def midnight(ts) -> Column:
    return F.to_timestamp_ntz(F.to_date(_c(ts)))


def iso(ts) -> Column:
    """ISO text of a timestamp, 'YYYY-MM-DDTHH:MM:SS[.ffffff]' like Python's isoformat."""
    c = _c(ts)
    return F.when(F.date_format(c, "SSSSSS") == "000000", F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")) \
        .otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def with_defaults(df, defaults: dict):
    """fill NULLs of the named columns with the reference's fallbacks
    (importance 0.5, rerank 0.0, zero vector, error decision, no-insights text)."""
    out = df
    for name, value in defaults.items():
        if isinstance(value, (list, tuple)):
            lit = F.array(*[F.lit(v) for v in value]).cast(df.schema[name].dataType)
        else:
            lit = F.lit(value).cast(df.schema[name].dataType)
        out = out.withColumn(name, F.coalesce(F.col(name), lit))
    return out


def ntz_micros(ts) -> Column:
    """Microseconds since 1970-01-01 of a ``timestamp_ntz``, from its date and time parts,
    so the result does not depend on the session time zone (a cast to ``timestamp``
    would shift, or merge, wall-clock times around daylight-saving changes)."""
    c = _c(ts)
    return (F.unix_date(F.to_date(c)).cast("long") * F.lit(86_400_000_000)
            + F.hour(c).cast("long") * F.lit(3_600_000_000)
            + F.minute(c).cast("long") * F.lit(60_000_000)
            + F.second(c).cast("long") * F.lit(1_000_000)
            + F.date_format(c, "SSSSSS").cast("long"))
