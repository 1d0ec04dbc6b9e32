"""Run a registered query in Spark and its SQL twin in DuckDB, and compare.

Comparison: same column names, same row count, same rows as a multiset
(doubles compared after rounding to 6 places).

    python -m tests.oracle_util [key ...]        # sf0.01 by default
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            return v
    return v


def rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = [tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> tuple[bool, str]:
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return False, f"columns differ: {sorted(spark_pdf.columns)} vs {sorted(duck_pdf.columns)}"
    if len(spark_pdf) != len(duck_pdf):
        return False, f"row count {len(spark_pdf)} vs {len(duck_pdf)}"
    a, b = rows(spark_pdf), rows(duck_pdf)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)} rows differ, first: {bad[0]}"
    return True, f"{len(a)} rows"


def check(spark, key: str, sf_dir: str) -> tuple[bool, str]:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as E
    q, sql = E.queries()[key], E.oracle_sql().get(key)
    t0 = time.time()
    sp = q(spark, sf_dir).toPandas()
    t1 = time.time()
    if sql is None:
        return True, f"{len(sp)} rows (no SQL), spark {t1 - t0:.1f}s"
    dk = duck(sf_dir).execute(sql).fetchdf()
    ok, msg = compare(sp, dk)
    return ok, f"{msg}, spark {t1 - t0:.1f}s"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from glint.session import get_session
    import __spark_entry__ as E
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = get_session("local[8]", 8)
    keys = sys.argv[1:] or list(E.queries())
    bad = 0
    for k in keys:
        try:
            ok, msg = check(spark, k, sf)
        except Exception as e:  # report and go on
            ok, msg = False, f"ERROR {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {k}: {msg}", flush=True)
    print(f"{len(keys) - bad}/{len(keys)} ok")
