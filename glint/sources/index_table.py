"""A BM25 index that is refreshed by deltas (S6, A4): a refresh reads changed documents only.

``<base>/forward`` holds one row per document and version (``doc_id, dl, terms, tfs, gone``), in folders by
version and by bucket of the id; ``<base>/changes`` the signed changes of document frequencies
(``term, change``) with the bounds of new rows (``top_tf, least_dl``; those of gone rows stay, a bound may be wide) and ``<base>/corpus`` the signed changes of the document and token counts, by version. A refresh
counts the new documents in place, reads the former rows of the same ids from their buckets alone, and
appends what changed; statistics are the sums over all versions. ``compact`` folds the versions into one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glint.operators.text_index import BM25Index, bounded_broadcast, forward_rows, postings_of, with_idf

BUCKETS = 64


def _bucket() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")


def _read(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base.rstrip('/')}/{name}")


def _write(rows: DataFrame, base: str, name: str, version: int, *by: str) -> None:
    rows.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version", *by).parquet(
        f"{base.rstrip('/')}/{name}")


def _append(base: str, version: int, rows: DataFrame, former: DataFrame | None) -> None:
    """Write a version: its forward rows, and the changes against the ``former`` rows of the same documents."""
    spark = rows.sparkSession
    spread = rows.withColumn("bucket", _bucket()).repartition("bucket")     # a bucket is one file of a version
    _write(spread, base, "forward", version, "bucket")
    new = _read(spark, base, "forward").filter((F.col("version") == version) & ~F.col("gone"))
    signed = new.select("doc_id", "dl", "terms", "tfs", F.lit(1).alias("sign"))
    if former is not None:
        signed = signed.unionByName(former.select("doc_id", "dl", "terms", "tfs", F.lit(-1).alias("sign")))
    changes = postings_of(signed, "sign").groupBy("term").agg(
        F.sum("sign").alias("change"), F.max(F.when(F.col("sign") > 0, F.col("tf"))).alias("top_tf"),
        F.min(F.when(F.col("sign") > 0, F.col("dl"))).alias("least_dl"))
    _write(changes, base, "changes", version)
    _write(signed.agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("docs"),
                      F.coalesce(F.sum(F.col("sign") * F.col("dl")), F.lit(0)).alias("tokens")), base, "corpus", version)


def create(docs: DataFrame, base: str, doc_id: str = "doc_id", text: str = "content") -> None:
    """Version 0: all documents, one row per id."""
    _append(base, 0, forward_rows(docs, doc_id, text).withColumn("gone", F.lit(False)), None)


def current(forward: DataFrame) -> DataFrame:
    """The newest row of every document that is not gone. Version 0 is not shuffled: the ids of later versions
    are joined to it (by broadcast, when their measured size allows)."""
    later = forward.filter(F.col("version") > 0)
    newest = later.groupBy("doc_id").agg(F.max("version").alias("version"))
    first = forward.filter(F.col("version") == 0).join(bounded_broadcast(newest.select("doc_id")), "doc_id", "left_anti")
    rows = first.unionByName(later.join(newest, ["doc_id", "version"]).select(*first.columns))
    return rows.filter(~F.col("gone"))


def refresh(spark: SparkSession, base: str, changed: DataFrame, removed: DataFrame | None = None,
            doc_id: str = "doc_id", text: str = "content") -> int:
    """Append a version with the ``changed`` (new or rewritten, one row per id) and ``removed`` documents."""
    version = _read(spark, base, "corpus").agg(F.max("version")).first()[0] + 1
    rows = forward_rows(changed, doc_id, text).withColumn("gone", F.lit(False))
    if removed is not None:
        gone = removed.select(F.col(doc_id).alias("doc_id")).distinct().join(rows.select("doc_id"), "doc_id", "left_anti")
        rows = rows.unionByName(gone.select("doc_id", F.lit(0).alias("dl"), F.array().cast("array<string>").alias("terms"),
                                            F.array().cast("array<bigint>").alias("tfs"), F.lit(True).alias("gone")))
    rows = rows.persist()
    _append(base, version, rows, former_rows(spark, base, rows, version))
    rows.unpersist()
    return version


def former_rows(spark: SparkSession, base: str, rows: DataFrame, version: int) -> DataFrame:
    """What the index held of the ids of ``rows`` before ``version``; only their buckets are read."""
    ids = rows.select("doc_id")
    buckets = [r[0] for r in ids.select(_bucket()).distinct().collect()]            # at most BUCKETS numbers
    stored = _read(spark, base, "forward").filter((F.col("version") < version) & F.col("bucket").isin(buckets))
    return current(stored.join(bounded_broadcast(ids), "doc_id", "left_semi"))


def load(spark: SparkSession, base: str, variant: str = "okapi") -> BM25Index:
    """The index as it is now."""
    forward = current(_read(spark, base, "forward")).select("doc_id", "dl", "terms", "tfs")
    dfs = _read(spark, base, "changes").groupBy("term").agg(
        F.sum("change").alias("df"), F.max("top_tf").alias("top_tf"), F.min("least_dl").alias("least_dl"))
    dfs = dfs.filter(F.col("df") > 0).persist()
    n, total = _read(spark, base, "corpus").agg(F.sum("docs"), F.sum("tokens")).first()
    return BM25Index(forward, with_idf(dfs, n, variant), n, float(total) / n if n else 0.0, variant)


def compact(spark: SparkSession, base: str, target: str) -> None:
    """The index as one version in the folder ``target``."""
    rows = current(_read(spark, base, "forward")).select("doc_id", "dl", "terms", "tfs", "gone")
    _append(target, 0, rows, None)
