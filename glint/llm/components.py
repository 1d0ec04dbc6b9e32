"""Connected components of a table of links, by contraction in hashed order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glint.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id that occurs in ``links`` (a long, b long); component is the smallest id.

    Each round maps every vertex to the least of itself and its neighbours in the order of a
    hash, and replaces the links by those between the images. The hashed order makes a chain
    shrink by a constant factor, so rounds grow with the logarithm of the diameter. Nulls and
    links of an id with itself are ignored. Every round is written to the shared folder.
    """
    edges = stored(links.filter("a is not null and b is not null and a <> b").select("a", "b").distinct(), "links")
    ids = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    maps = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        order = F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("v"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("v"))
        step = (both.groupBy("a").agg(F.min(order).alias("near"))
                .select(F.col("a").alias("id"), F.least("near", own)["v"].alias("to")))
        step = stored(step, "contract")
        maps.append(step)
        edges = stored(edges.join(step.select(F.col("id").alias("a"), F.col("to").alias("x")), "a")
                       .join(step.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
                       .filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
                       .distinct(), "links")
    found = ids.select("id", F.col("id").alias("root"))
    for step in maps:
        found = (found.join(step.withColumnRenamed("id", "root"), "root", "left")
                 .select("id", F.coalesce("to", "root").alias("root")))
    found = stored(found, "roots")
    least = found.groupBy("root").agg(F.min("id").alias("component"))
    return found.join(least, "root").select("id", "component")
