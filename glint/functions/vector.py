"""Vector column functions over ``array<float|double>`` (V3-V5).

Built from ``zip_with`` + ``aggregate`` so they stay inside whole-stage codegen.
Inputs are cast to double before multiplying.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("array<double>")


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return _sum(F.zip_with(_d(a), _d(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(_sum(F.transform(_d(a), lambda x: x * x)))


def cosine(a, b) -> Column:
    """Cosine similarity; NULL-safe: 0 when a norm is 0 (like the encoder fallback)."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def l2sq(a, b) -> Column:
    """Squared Euclidean distance, smaller is closer."""
    return _sum(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y)))
