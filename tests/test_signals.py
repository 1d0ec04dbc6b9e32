"""Indicator windows and context classes on hand-written bars (every branch, every bound)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from glint.operators import signals


def bars(spark, rows):
    t0 = dt.datetime(2024, 1, 1, 9, 30)
    data = [(s, t0 + dt.timedelta(minutes=i), float(c), float(v)) for s, i, c, v in rows]
    return spark.createDataFrame(data, "symbol string, timestamp timestamp_ntz, close double, volume double")


def test_first_row_and_constant_prices(spark):
    df = bars(spark, [("A", i, 10.0, 5.0) for i in range(30)])
    out = signals.indicators(df).orderBy("timestamp").collect()
    assert out[0]["stddev_20"] is None and out[0]["z_score"] is None   # one row: no sample stddev
    assert out[5]["stddev_20"] == 0.0 and out[5]["z_score"] is None    # zero stddev: NULL, no error
    assert all(r["trend"] == "NEUTRAL" for r in out)


def test_zero_volume_ratio_is_null(spark):
    df = bars(spark, [("A", i, 10.0 + i, 0.0) for i in range(5)])
    out = signals.indicators(df).collect()
    assert all(r["volume_ratio"] is None for r in out)


def test_frames_include_current_row(spark):
    df = bars(spark, [("A", i, float(i), 1.0) for i in range(60)])
    r = signals.indicators(df).filter(F.col("close") == 59.0).first()
    assert r["sma_20"] == pytest.approx(sum(range(39, 60)) / 21)     # 20 preceding + current
    assert r["sma_50"] == pytest.approx(sum(range(9, 60)) / 51)


@pytest.mark.parametrize("closes,trend", [
    (list(range(1, 61)), "STRONG_UPTREND"),
    (list(range(60, 0, -1)), "STRONG_DOWNTREND"),
    ([1, 2, 3, 4, 10], "UPTREND"),            # under 21 rows both averages are equal
    ([10, 9, 8, 7, 1], "DOWNTREND"),
])
def test_trend_labels(spark, closes, trend):
    df = bars(spark, [("A", i, c, 1.0) for i, c in enumerate(closes)])
    last = signals.latest_per_symbol(signals.indicators(df)).first()
    assert last["trend"] == trend


def test_context_bounds(spark):
    schema = "close double, sma_20 double, z_score double, volume_ratio double, trend string"
    rows = [(105.0, 100.0, 2.0, 2.0, "UPTREND"),        # exactly at the bounds: not above
            (106.0, 100.0, 2.01, 2.01, "STRONG_UPTREND"),
            (95.0, 100.0, -1.0, 1.5, "DOWNTREND"),
            (94.0, 100.0, -1.5, 0.5, "STRONG_DOWNTREND"),
            (100.0, 100.0, None, None, "NEUTRAL"),
            (101.0, 100.0, 0.5, 0.49, "UPTREND")]
    out = signals.market_context(spark.createDataFrame(rows, schema)).collect()
    got = [(r["trend_strength"], r["volatility_level"], r["volume_signal"], r["price_momentum"]) for r in out]
    assert got == [(0.5, "MEDIUM", "HIGH", "POSITIVE"),
                   (1.0, "HIGH", "VERY_HIGH", "STRONG_POSITIVE"),
                   (-0.5, "LOW", "NORMAL", "NEGATIVE"),
                   (-1.0, "MEDIUM", "NORMAL", "STRONG_NEGATIVE"),
                   (0.0, "LOW", "NORMAL", "NEUTRAL"),
                   (0.5, "LOW", "LOW", "POSITIVE")]


def test_chunked_halo_equals_plain(spark):
    """Sparse and dense days, a chunk of one row, a gap of many empty days."""
    import random
    random.seed(3)
    rows, t = [], 0
    for i in range(400):
        t += random.choice([1, 2, 60, 600, 3000, 20000])
        rows.append(("H" if i % 3 else "C", t, round(random.uniform(1, 100), 2), float(random.randint(0, 9))))
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(s, t0 + dt.timedelta(minutes=m), c, v) for s, m, c, v in rows],
                               "symbol string, timestamp timestamp_ntz, close double, volume double")
    cols = ["symbol", "timestamp", "sma_20", "sma_50", "stddev_20", "avg_volume_20", "trend"]
    a = sorted(tuple(r) for r in signals.indicators(df).select(*cols).collect())
    variants = [dict(chunk_seconds=3600), dict(chunk_seconds=86_400), dict(split=True, rows_per_piece=25),
                dict(split=True, rows_per_piece=90), dict(split=True)]
    for kw in variants:
        b = sorted(tuple(r) for r in signals.indicators(df, **kw).select(*cols).collect())
        assert len(a) == len(b)
        for x, y in zip(a, b):
            assert x[:2] == y[:2] and x[-1] == y[-1]
            for u, v in zip(x[2:-1], y[2:-1]):
                assert (u is None and v is None) or u == pytest.approx(v, rel=1e-12, abs=1e-12)


def test_newest_bars_group_limit(spark):
    df = bars(spark, [("A", i, 1.0, 1.0) for i in range(50)] + [("B", i, 1.0, 1.0) for i in range(3)])
    out = signals.newest_bars(df, 10)
    assert {r["symbol"]: r["n"] for r in out.groupBy("symbol").agg(F.count("*").alias("n")).collect()} == \
        {"A": 10, "B": 3}


def test_pieces_with_equal_times_equal_the_plain_windows(spark):
    """Bars of equal time (ordered by id), a symbol of one row, pieces shorter than a frame."""
    import random
    random.seed(9)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, "H" if i % 4 else "C", t0 + dt.timedelta(minutes=random.randint(0, 60)), random.uniform(1, 9), None if i % 11 == 0
             else float(i % 5)) for i in range(300)] + [(999, "one", t0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, symbol string, timestamp timestamp_ntz, close double, volume double")
    cols = ["symbol", "timestamp", "close", "sma_20", "sma_50", "stddev_20", "avg_volume_20", "trend"]
    key = lambda r: (r[0], r[1], r[2])
    a = sorted((tuple(r) for r in signals.indicators(df).select(*cols).collect()), key=key)
    for n in (10, 60):
        b = sorted((tuple(r) for r in signals.indicators(df, split=True, rows_per_piece=n).select(*cols).collect()), key=key)
        assert [x[:3] + x[-1:] for x in a] == [x[:3] + x[-1:] for x in b]
        for x, y in zip(a, b, strict=True):
            assert [v is None for v in x] == [v is None for v in y]
            assert [v for v in x[3:-1] if v is not None] == pytest.approx([v for v in y[3:-1] if v is not None], rel=1e-9)


def test_many_cuts_are_searched_in_two_levels(spark, monkeypatch):
    """A row carries a square root of its key's cuts, and gets the same piece as by all of them at once; keys with one
    piece and rows without time too."""
    from glint.operators import history as H
    t0 = dt.datetime(2024, 1, 1)
    rows = [("A", t0 + dt.timedelta(seconds=i // 2)) for i in range(6000)] + [("A", t0)] * 300
    rows += [("B", t0 + dt.timedelta(seconds=i * i)) for i in range(900)] + [("C", t0), ("A", None), (None, t0)]
    df = spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz")
    pieces = H.with_pieces(df, "symbol", "timestamp", 20)
    got = sorted(pieces.collect(), key=str)
    assert "_coarse" in pieces._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(H, "CUTS_AT_ONCE", 1 << 20)
    assert got == sorted(H.with_pieces(df, "symbol", "timestamp", 20).collect(), key=str)
    assert max(r["_c"] for r in got if r["symbol"] == "A") > 100
    for symbol in "AB":
        seen = [r["_c"] for r in sorted((r for r in got if r["symbol"] == symbol and r["timestamp"]), key=lambda r: r["timestamp"])]
        assert seen == sorted(seen)


def test_last_rows_of_a_piece_go_only_to_pieces_that_need_them(spark):
    """With pieces as long as a frame the rows before a piece come from its neighbour alone."""
    df = bars(spark, [(s, i, (i * 7) % 13 + 1, i % 5) for s in "AB" for i in range(600)])
    out = signals.indicators(df, split=True, rows_per_piece=100)
    assert "_reach" in out._jdf.queryExecution().analyzed().toString()
    plain = signals.indicators(df)
    assert sorted(map(str, out.collect())) == sorted(map(str, plain.collect()))
