"""Model hooks with working and failing functions, defaults, and message decoding."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from glint.functions.scalar import with_defaults
from glint.operators import assemble as A
from glint.operators import models as MD
from glint.streaming import market as MK


def test_decide_with_model_and_failure(spark):
    df = spark.createDataFrame([("A", "text a"), ("B", "text b")], "symbol string, analysis_text string")
    ok = A.decide(df, lambda ts: [(f"BUY {t}", True) for t in ts], lambda ts: ["confident, bold" for _ in ts])
    rows = {r["symbol"]: r for r in ok.collect()}
    assert rows["A"]["recommendation"] == "BUY text a" and rows["A"]["confidence"] is True
    assert list(rows["A"]["sentiment"]) == ["confident", "bold"]

    def broken(texts):
        raise RuntimeError("model down")
    bad = A.decide(df, broken, lambda ts: ["x" for _ in ts]).collect()
    assert all(r["recommendation"] == "Error analyzing trading opportunity" and r["confidence"] is False
               and list(r["sentiment"]) == ["uncertain"] for r in bad)


def test_embed_failure_gives_zero_vectors(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "id long, content string")

    def broken(texts):
        raise RuntimeError("no network")
    out = MD.embed(df, "content", broken, dim=4).collect()
    assert all(list(r["embedding"]) == [0.0] * 4 for r in out)
    hashed = MD.embed(df, "content", None, dim=8).collect()      # default: hashing, unit length
    assert all(abs(sum(x * x for x in r["embedding"]) - 1.0) < 1e-6 for r in hashed)


def test_with_defaults(spark):
    df = spark.createDataFrame([(None, None, None), (0.9, 0.3, ["x"])],
                               "importance double, reranking_score double, sentiment array<string>")
    out = with_defaults(df, {"importance": 0.5, "reranking_score": 0.0, "sentiment": ["uncertain"]}).collect()
    assert (out[0]["importance"], out[0]["reranking_score"], list(out[0]["sentiment"])) == (0.5, 0.0, ["uncertain"])
    assert (out[1]["importance"], out[1]["reranking_score"], list(out[1]["sentiment"])) == (0.9, 0.3, ["x"])


def test_decode_objects_lists_and_broken_records(spark):
    raw = spark.createDataFrame([
        ('{"kind": "bar", "symbol": "A", "timestamp": "2024-01-01T00:00:01", "close": 1.5, "volume": 2}',),
        ('[{"kind": "trade", "symbol": "B", "timestamp": "2024-01-01T00:00:02", "close": 2.5, "volume": 1},'
         ' {"kind": "quote", "symbol": "B", "timestamp": "2024-01-01T00:00:03", "close": 2.6, "volume": 1}]',),
        ('{"kind": "bar", "symbol": ',),
        ('{"kind": "news", "symbol": "C", "timestamp": "2024-01-01T00:00:04"}',),
        ('not json at all',),
    ], "value string")
    good, bad = MK.decode_messages(raw)
    g = sorted((r["kind"], r["symbol"]) for r in good.collect())
    assert g == [("bar", "A"), ("quote", "B"), ("trade", "B")]
    assert bad.count() == 3
    enc = MK.encode_messages(good).collect()
    assert {r["key"] for r in enc} == {"A", "B"} and all(r["value"].startswith("{") for r in enc)
    back, _ = MK.decode_messages(MK.encode_messages(good).select("value"))
    assert back.count() == 3 and back.filter(F.col("timestamp").isNull()).count() == 0


class FakeState:
    """Stand-in for GroupState in direct tests of the state functions."""

    def __init__(self, value=None, timed_out=False):
        self.value, self.hasTimedOut, self.removed, self.timeout = value, timed_out, False, None

    @property
    def exists(self):
        return self.value is not None

    @property
    def get(self):
        return self.value

    def update(self, v):
        self.value = v

    def remove(self):
        self.value, self.removed = None, True

    def setTimeoutTimestamp(self, ms):
        self.timeout = ms


def test_stream_indicators_state_and_late_rows():
    import datetime as dt

    import pandas as pd

    from glint.streaming.state import _indicator_state
    t0 = dt.datetime(2024, 1, 1)
    b1 = pd.DataFrame({"symbol": "A", "timestamp": [t0 + dt.timedelta(minutes=i) for i in range(30)],
                       "close": [float(i) for i in range(30)], "volume": 1.0})
    st = FakeState()
    out1 = next(_indicator_state(("A",), [b1], st))
    assert len(st.value[0]) == 30 and not out1["late"].any()
    b2 = pd.DataFrame({"symbol": "A", "timestamp": [t0 + dt.timedelta(minutes=30), t0 + dt.timedelta(minutes=5)],
                       "close": [30.0, 99.0], "volume": 1.0})
    out2 = next(_indicator_state(("A",), [b2], st))
    fresh = out2[~out2["late"]].iloc[0]
    assert fresh["sma_20"] == sum(range(10, 31)) / 21          # frame continues from state
    assert out2["late"].sum() == 1 and pd.isna(out2[out2["late"]].iloc[0]["sma_20"])


def test_stream_throttle_state_and_timeout():
    import datetime as dt

    import pandas as pd

    from glint.streaming.state import _throttle_state
    fn = _throttle_state(300 * 1_000_000)
    t0 = dt.datetime(2024, 1, 1)
    rows = pd.DataFrame({"symbol": "A", "timestamp": [t0, t0 + dt.timedelta(seconds=100),
                                                      t0 + dt.timedelta(seconds=400)], "id": [1, 2, 3]})
    st = FakeState()
    acc = next(fn(("A",), [rows], st))
    assert list(acc["id"]) == [1, 3] and st.timeout is not None
    more = pd.DataFrame({"symbol": "A", "timestamp": [t0 + dt.timedelta(seconds=500)], "id": [4]})
    assert len(next(fn(("A",), [more], st))) == 0                # within 5 minutes of the last accepted
    expired = FakeState(value=st.value, timed_out=True)
    assert list(fn(("A",), [more.iloc[:0]], expired)) == [] and expired.removed


@pytest.mark.parametrize(("rows_of_a_file", "files"), [(10, 3), (1000, 1)])
def test_a_part_of_the_input_is_many_files_in_time_order(spark, tmp_path, monkeypatch, rows_of_a_file, files):
    from glint.plans import q_streams as Q
    monkeypatch.setattr(Q, "FILE_ROWS", rows_of_a_file)
    rows = spark.range(0, 130, numPartitions=3).select(F.col("id").alias("at"), (F.col("id") * 2).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([(None, -1)], "at long, v long"))         # without a time: not sent
    base = str(tmp_path / "in")
    assert Q._in_parts(rows, F.col("at"), lambda part, i: part.write.parquet(f"{base}/q{i}")) == files
    seen = []
    for part in sorted(tmp_path.glob("in/q*")):
        assert len(list(part.glob("part-*"))) == files
        seen.append(sorted(r["at"] for r in spark.read.parquet(str(part)).collect()))
    assert len(seen) == 4 and [a for part in seen for a in part] == list(range(130))


def test_types_and_days_of_a_batch_are_found_without_its_ids(spark, tmp_path, monkeypatch):
    batches, stored = [], MD.stored_ids
    monkeypatch.setattr(MD, "stored_ids", lambda s, path, batch: batches.append(batch) or stored(s, path, batch))
    df = spark.createDataFrame([(1, "x", "t", dt.datetime(2024, 1, 1), 0.5, {"a": "b"})] * 2,
                               "memory_id long, memory_type string, content string, timestamp timestamp_ntz, "
                               "importance double, metadata map<string,string>")
    for _ in range(2):
        MD.append_memories(df, str(tmp_path / "mem"))
    assert len(batches) == 2 and all("Window" not in b._jdf.queryExecution().toString() for b in batches)
    assert spark.read.parquet(str(tmp_path / "mem")).count() == 1
