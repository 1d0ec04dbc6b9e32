"""Research items from several sources into one table, and the best few per source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Research sources and how many items each contributes.
SOURCES = ["news", "academic", "financial"]
PER_SOURCE = 3
ACADEMIC_LIMIT = 10


def gather_research(sources: dict[str, DataFrame], wanted: list[str]) -> DataFrame:
    """Union of the wanted sources, each tagged with its own name at its origin.

    Sources may lack columns (news has no authors, say): ``allowMissingColumns``.
    A requested source that is absent contributes nothing (the reference returns
    nothing for financial reports).
    """
    parts = [df.withColumn("source", F.lit(name)) for name, df in sources.items() if name in wanted]
    if not parts:
        raise ValueError("no requested source is available")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def top_research(items: DataFrame, n: int = PER_SOURCE, academic_limit: int = ACADEMIC_LIMIT,
                 by: list[str] | None = None) -> DataFrame:
    """First ``n`` items per (``by`` keys, source) by relevance, ties by item id.
    The academic source is first cut to its ``academic_limit`` most relevant items,
    which does not change its first ``n`` when ``n <= academic_limit``.
    A per-group limit: partial before the shuffle, so a hot source is cut map-side."""
    keys = (by or []) + ["source"]
    w = Window.partitionBy(*keys).orderBy(F.col("relevance").desc(), F.col("item_id"))
    limit = F.when(F.col("source") == "academic", F.lit(min(n, academic_limit))).otherwise(F.lit(n))
    ranked = items.withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= F.lit(max(n, 1))).filter(F.col("rank") <= limit)
