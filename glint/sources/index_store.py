"""BM25 index snapshots as parquet tables.

A snapshot is a folder ``<base>/rag_index_<version>`` holding the index grouped by document
(``forward``, with the carried document columns), ``terms`` and a one-row ``corpus`` table, plus a row in ``<base>/_log`` (name, path, mtime, series). A loaded index scores
exactly like the one saved.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glint.operators.history import latest_snapshot
from glint.operators.text_index import BM25Index, forward_rows, index_of


def _path(base: str, version: str) -> str:
    return f"{base.rstrip('/')}/rag_index_{version}"


def _finish(index: BM25Index, base: str, version: str, mtime: _dt.datetime, series: int) -> str:
    spark, path = index.forward.sparkSession, _path(base, version)
    index.terms.select("term", "df", "idf", "top_tf", "least_dl").write.mode("overwrite").parquet(f"{path}/terms")
    spark.createDataFrame([(index.n_docs, float(index.avgdl), index.variant)],
                          "n_docs long, avgdl double, variant string") \
        .write.mode("overwrite").parquet(f"{path}/corpus")
    spark.createDataFrame([(f"rag_index_{version}.pkl", path, mtime, series)],
                          "name string, path string, mtime timestamp_ntz, series long") \
        .write.mode("append").parquet(f"{base.rstrip('/')}/_log")
    return path


def save_index(index: BM25Index, base: str, version: str, mtime: _dt.datetime, series: int = 0) -> str:
    """Write the index tables and append one row to the snapshot log. ``mtime`` is the time of the snapshot."""
    index.forward.write.mode("overwrite").parquet(f"{_path(base, version)}/forward")
    return _finish(index, base, version, mtime, series)


def build_snapshot(docs: DataFrame, base: str, version: str, mtime: _dt.datetime, variant: str = "okapi",
                   series: int = 0, carry: tuple = ()) -> str:
    """Index ``docs`` (``doc_id, content``, columns ``carry``) straight into a snapshot: one pass writes the forward index,
    and the statistics are taken from what was written."""
    forward = f"{_path(base, version)}/forward"
    forward_rows(docs, carry=carry).write.mode("overwrite").parquet(forward)
    return _finish(index_of(docs.sparkSession.read.parquet(forward), variant), base, version, mtime, series)


def load_index(spark: SparkSession, path: str) -> BM25Index:
    c = spark.read.parquet(f"{path}/corpus").first()
    return BM25Index(spark.read.parquet(f"{path}/forward"), spark.read.parquet(f"{path}/terms"),
                     int(c["n_docs"]), float(c["avgdl"]), c["variant"])


def load_latest(spark: SparkSession, base: str, series: int = 0) -> BM25Index:
    """Newest snapshot of a series by modified time."""
    log = spark.read.parquet(f"{base.rstrip('/')}/_log").filter(F.col("series") == series)
    row = latest_snapshot(log, pattern=r"^rag_index_.*\.pkl$").first()
    return load_index(spark, row["path"])
