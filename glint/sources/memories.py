"""The memory table on disk: one parquet dataset in folders by ``memory_type`` and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_memories(spark: SparkSession, path: str, memory_type: str | None = None) -> DataFrame:
    """All memories, or one type; the type filter prunes partitions."""
    df = spark.read.parquet(path).drop("day")
    return df if memory_type is None else df.filter(F.col("memory_type") == memory_type)


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The bar table (S1): ``symbol, timestamp, close, volume`` from any file source."""
    df = spark.read.format(fmt).load(path)
    return df.select(F.col("symbol").cast("string"), F.col("timestamp").cast("timestamp_ntz"),
                     F.col("close").cast("double"), F.col("volume").cast("double"))
