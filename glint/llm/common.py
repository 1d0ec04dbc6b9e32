"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glint.session import shared_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that ``spark.checkpoint.dir`` names (all executors share it)."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def schema_with(df: DataFrame, **new: T.DataType) -> T.StructType:
    """The schema of ``df`` with ``new`` columns at its end; same-named columns are replaced."""
    taken = {k.lower() for k in new}
    kept = [f for f in df.schema.fields if f.name.lower() not in taken]
    return T.StructType(kept + [T.StructField(k, v, True) for k, v in new.items()])


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that an operator is about to write."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def total_bytes(df: DataFrame, column: str) -> int:
    """Exact UTF-8 bytes of a text column (one row to the driver)."""
    return df.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0


def slices(batch, column: str, most: int):
    """Cut an Arrow batch into consecutive slices of about ``most`` UTF-8 bytes of ``column``."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def give_back() -> None:
    """Return freed memory of this worker to the system: workers outlive their tasks, and the next stage
    needs the memory too."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):          # another C library
        pass


def releasing(run):
    """The batch function ``run``, whose memory is given back when its task ends."""
    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()
    return tidied


def releasing_group(fit):
    """The group function ``fit``, whose memory is given back when it returns (for few groups only)."""
    @functools.wraps(fit)
    def tidied(rows):
        try:
            return fit(rows)
        finally:
            give_back()
    return tidied
