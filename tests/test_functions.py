"""Scalar functions: formatting, scores, metadata, session label, tokens."""

import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glint.functions import scalar as SC
from glint.functions.text import fmt_fixed, session_label, tokenize


def test_fmt_fixed_matches_python(spark):
    random.seed(7)
    vals = [0.975, 2.675, 0.125, 1.005, -2.675, 0.5, 1.5, 2.5, 123456.785, 1e-9, 99.995]
    vals += [round(random.uniform(-1000, 1000), random.randint(0, 4)) for _ in range(500)]
    vals = [v for v in vals if v != 0.0] + [0.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for places in (2, 4):
        got = [r[0] for r in df.select(fmt_fixed("x", places)).collect()]
        assert got == [f"{v:.{places}f}" for v in vals]


def test_parse_score_and_sentinel(spark):
    rows = [(" 0.7 ", 1.0), ("abc", 1.0), ("1.7", 1.0), ("-3", 1.0), (None, 1.0), ("0.2", 0.8)]
    df = spark.createDataFrame(rows, "answer string, importance double")
    out = df.select(SC.resolve_importance(F.col("importance"), SC.parse_score(F.col("answer")))).collect()
    assert [r[0] for r in out] == [0.7, 0.5, 1.0, 0.0, 0.5, 0.8]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=32), min_size=1, max_size=20))
def test_clamp01_in_range(spark, xs):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    assert all(0.0 <= r[0] <= 1.0 for r in df.select(SC.clamp01("x")).collect())


def test_metadata_strip_and_merge(spark):
    df = spark.createDataFrame([({"symbol": "A", "importance": "0.3", "emotions": "x"},
                                 {"importance": "0.9", "timestamp": "t"})],
                               "a map<string,string>, b map<string,string>")
    r = df.select(SC.map_keys_text(SC.strip_reserved("a")).alias("s"),
                  SC.merge_metadata(F.col("a"), F.col("b")).alias("m")).first()
    assert r["s"] == "symbol"
    assert r["m"]["importance"] == "0.9" and r["m"]["symbol"] == "A" and r["m"]["timestamp"] == "t"


def test_session_label_bounds(spark):
    hours = [8, 9, 16, 17]
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, h, 59),) for h in hours], "t timestamp_ntz")
    got = [r[0] for r in df.select(session_label("t")).collect()]
    assert got == ["Extended Hours", "Normal Trading Hours", "Normal Trading Hours", "Extended Hours"]


def test_tokenize(spark):
    df = spark.createDataFrame([("Don't STOP, 42x!",), ("",)], "t string")
    got = [r[0] for r in df.select(tokenize("t")).collect()]
    assert got == [["don", "'", "t", "stop", ",", "42x", "!"], []]
