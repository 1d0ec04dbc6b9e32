"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings that matter at scale; every one is a plain Spark setting.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "glint", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings above.

    On a cluster pass ``master=None`` and let spark-submit decide.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python workers import it (Spark distributes the archive)."""
    home = os.path.dirname(os.path.abspath(__file__))
    if any(f.endswith("/glint.zip") for f in spark.sparkContext.listFiles):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="glint-ship-"), "glint.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(home):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(home)))
    spark.sparkContext.addPyFile(archive)


def shared_dir(spark: SparkSession, sub: str | None = None) -> str:
    """Folder for written tables and checkpoints, shared by all executors.

    Read from ``spark.checkpoint.dir`` (the cluster names it). Only on a local
    master, as in tests, a scratch folder is created and registered when it is
    unset; elsewhere executors would not see it, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="glint-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
    spark.sparkContext.setCheckpointDir(base)
    if sub is None:
        return base
    path = os.path.join(base, f"{sub}-{uuid.uuid4().hex[:12]}") if "://" not in base \
        else f"{base.rstrip('/')}/{sub}-{uuid.uuid4().hex[:12]}"
    return path


def written(df, name: str):
    """Write ``df`` to the shared folder and read it back: computed once, lineage cut, lost executors survived."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df):
    """Round-robin a DataFrame over the cluster when it has fewer partitions than
    cores (one big file, one row group). Inputs already split finer are left as
    they are, so on a large cluster reading many files this adds no shuffle.

    For scans only: asking a plan with a join for its partitions runs its shuffles once more."""
    par = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < par:
        return df.repartition(par)
    return df
