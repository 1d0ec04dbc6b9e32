"""

Every query takes ``(spark, sf_dir)``, reads whole tables and returns a DataFrame.
Doubles are rounded to 9 places on both sides; every computed column is aliased
to the same name in Spark and in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def round_doubles(df: DataFrame, places: int = 9) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), places).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# Import the query modules so their ``register`` calls run.
from glint.plans import q_signals  # noqa: E402,F401
from glint.plans import q_history  # noqa: E402,F401
from glint.plans import q_memory  # noqa: E402,F401
from glint.plans import q_retrieval  # noqa: E402,F401
from glint.plans import q_assemble  # noqa: E402,F401
from glint.plans import q_models  # noqa: E402,F401
from glint.plans import q_streams  # noqa: E402,F401
from glint.plans import q_chain  # noqa: E402,F401
