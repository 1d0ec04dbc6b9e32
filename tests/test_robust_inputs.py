"""Broken rows must not break jobs, nor their neighbours."""

import numpy as np
from pyspark.sql import functions as F

from glint.functions.scalar import parse_score
from glint.operators.memory import filter_memories
from glint.operators.models import embed, enrich
from glint.sources.json_rows import from_json_rows
from glint.streaming.market import decode_messages
from glint.streaming.state import _frame_mean


def _ask(prompts):
    if any("bad" in p for p in prompts):
        raise ValueError("no answer")
    return [p.upper() for p in prompts]


def _vectors(texts):
    if any("bad" in t for t in texts):
        raise ValueError("no vector")
    return [[float(len(t)), 1.0] for t in texts]


def test_only_failing_items_fall_back(spark):
    df = spark.createDataFrame([(i, "bad" if i % 50 == 7 else f"t{i}") for i in range(500)], "id long, t string").repartition(2)
    rows = enrich(df, "t", _ask, "a", "none", failed="f").collect()
    assert len(rows) == 500
    for r in rows:
        assert (r["a"], r["f"]) == (("none", True) if r["t"] == "bad" else (r["t"].upper(), False))
    for r in embed(df, "t", _vectors, dim=2, failed="f").collect():
        assert (r["embedding"], r["f"]) == (([0.0, 0.0], True) if r["t"] == "bad" else ([float(len(r["t"])), 1.0], False))


def test_malformed_times(spark):
    good = '{"kind":"quote","symbol":"A","timestamp":"2024-01-02T03:04:05","close":1.0,"volume":2}'
    bad = good.replace("2024-01-02T03:04:05", "garbage")
    ok, out = decode_messages(spark.createDataFrame([(good,), (bad,)], "value string"))
    assert [r["value"] for r in out.collect()].count(bad) == 1 and ok.filter("timestamp is null").count() == 0
    rows = from_json_rows(spark.createDataFrame([("k", '{"timestamp":"garbage"}')], "key string, json string"), "key")
    assert rows.collect()[0]["timestamp"] is None


def test_scores_are_plain_numbers(spark):
    df = spark.createDataFrame([("1d",), ("0.3f",), (" 0.25 ",), ("1e-1",), ("x",), (None,), ("7",)], "t string")
    assert [r[0] for r in df.select(parse_score("t")).collect()] == [0.5, 0.5, 0.25, 0.1, 0.5, 0.5, 1.0]


def test_one_sided_ranges(spark):
    df = spark.createDataFrame([("m", 0.9, "2024-01-01 00:00:00"), ("m", 0.9, "2024-01-03 00:00:00")],
                               "memory_type string, importance double, t string")
    df = df.withColumn("timestamp", F.col("t").cast("timestamp_ntz"))
    assert filter_memories(df, start="2024-01-02 00:00:00").count() == 1
    assert filter_memories(df, end="2024-01-02 00:00:00").count() == 1
    assert filter_memories(df).count() == 2


def test_unknown_prices_are_skipped():
    got = _frame_mean(np.array([1.0, 2.0, np.nan, 4.0, 5.0]), 21)
    assert np.allclose(got, [1.0, 1.5, 1.5, 7 / 3, 3.0])
    assert np.isnan(_frame_mean(np.array([np.nan]), 5)).all()
