"""Rows to and from JSON text with the reference's defaults.

Missing keys take defaults: importance 1.0, context / emotions / embedding NULL.
Text that is not JSON gives NULL fields (PERMISSIVE), never a failed job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPISODE_SCHEMA = ("content string, memory_type string, timestamp string, "
                  "metadata map<string,string>, importance double, context string, "
                  "emotions array<string>, embedding array<float>")

DOCUMENT_SCHEMA = "content string, metadata map<string,string>, embedding array<double>"


def to_json_rows(df: DataFrame, key: str, schema: str = EPISODE_SCHEMA) -> DataFrame:
    """``key, json``: the record's fields (those present) as one JSON text; times as ISO text."""
    names = [f.strip().split(" ")[0] for f in schema.split(", ")]
    fields = []
    for n in names:
        if n not in df.columns:
            continue
        c = F.col(n)
        if n == "timestamp":
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        fields.append(c.alias(n))
    return df.select(key, F.to_json(F.struct(*fields)).alias("json"))


def from_json_rows(df: DataFrame, key: str, schema: str = EPISODE_SCHEMA) -> DataFrame:
    """Parse ``json`` back to columns, with defaults for missing keys."""
    p = df.select(key, F.from_json("json", schema, {"mode": "PERMISSIVE"}).alias("r")).select(key, "r.*")
    if "importance" in p.columns:
        p = p.withColumn("importance", F.coalesce("importance", F.lit(1.0)))
    if "timestamp" in p.columns:
        p = p.withColumn("timestamp", F.col("timestamp").try_cast("timestamp_ntz"))     # malformed: NULL
    return p
