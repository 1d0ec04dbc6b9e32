"""TTL cache as keyed state: newest row per key, expiry, bounded state, restart."""

import datetime as dt
import random

import pyarrow as pa

from glint.streaming import cache as CA

SCHEMA = "symbol string, ts timestamp_ntz, event_id long, payload double"
T0 = dt.datetime(2024, 3, 10, 1, 0)


def feed(spark, path, n, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/q{n}")


def run(spark, path, checkpoint, **kw):
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/q*/part-*")
    q = CA.start_cache(src, checkpoint, **kw)
    q.awaitTermination()
    assert q.exception() is None


def state_rows(spark, checkpoint):
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "latest").load().count()


def test_newest_per_key_expiry_and_restart(spark, tmp_path):
    random.seed(2)
    path, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    rows, n = [], 0
    for batch in range(4):          # 50 minutes each; some rows arrive late, some times are equal
        new = []
        for _ in range(60):
            ts = T0 + dt.timedelta(minutes=50 * batch + random.randint(-20, 49))
            new.append((f"k{random.randint(0, 8)}", ts, n, random.random()))
            n += 1
        new.append((f"only{batch}", T0 + dt.timedelta(minutes=50 * batch), n, 0.5))
        new += [("tied", T0 + dt.timedelta(minutes=50 * batch + 1), n + i, float(i)) for i in (2, 3, 1)]
        new.append((None, T0, 7, 0.0))
        new.append(("null", None, 8, 0.0))
        n += 4
        rows += new
        feed(spark, path, batch, new)
        if batch in (1, 3):         # the second start goes on from the checkpoint
            run(spark, path, ck, ttl_seconds=3600)
    newest = {}
    for s, ts, i, p in rows:
        if s is not None and ts is not None:
            newest[s] = max(newest.get(s, (T0 - dt.timedelta(days=9), -1, 0.0)), (ts, i, p))
    now = max(r[1] for r in rows if r[1])
    want = {s: v for s, v in newest.items() if v[0] > now - dt.timedelta(hours=1)}
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")     # a clock change in between
    try:
        got = {r["symbol"]: (r["ts"], r["event_id"], r["payload"]) for r in
               CA.read_cache(spark, ck, now.isoformat(sep=" "), 3600).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == want and "only0" not in got and "tied" in got
    assert state_rows(spark, ck) < len(newest)              # keys that fell behind are gone from the state


def test_changes_are_passed_on(spark, tmp_path):
    path, ck, seen = str(tmp_path / "in"), str(tmp_path / "ck"), []
    feed(spark, path, 0, [("a", T0, 1, 1.0), ("a", T0, 2, 2.0)])
    feed(spark, path, 1, [("b", T0 + dt.timedelta(hours=5), 3, 3.0)])

    def keep(changes, batch_id):
        seen.extend((r["symbol"], r["event_id"], r["alive"]) for r in changes.collect())
    run(spark, path, ck, ttl_seconds=3600, on_change=keep)
    assert sorted(seen) == [("a", 2, False), ("a", 2, True), ("b", 3, True)]


def test_a_task_keeps_the_newest_row_of_keys_that_can_be_alive():
    random.seed(4)
    rows = [(random.choice("abcdefgh"), random.randint(0, 1000), random.choice([None, 2 ** 60 + 1, 2 ** 60 + 2])) for _ in range(90)]
    rows += [("old", 1000 - 301, 1), ("edge", 1000 - 300, None), ("last", 1000, 5)]
    random.shuffle(rows)
    names = ["symbol", "event_micros", "event_id"]
    batches = [pa.record_batch([list(c) for c in zip(*rows[i:i + 7], strict=True)], schema=pa.schema(
        [("symbol", pa.string()), ("event_micros", pa.int64()), ("event_id", pa.int64())])) for i in range(0, len(rows), 7)]
    got = [tuple(r[n] for n in names) for b in CA.combine("symbol", "event_id", 300)(iter(batches)) for r in b.to_pylist()]
    newest = {}
    for r in rows:
        if r[0] not in newest or (r[1], r[2] or 0) > (newest[r[0]][1], newest[r[0]][2] or 0):
            newest[r[0]] = r
    assert sorted(got) == sorted(r for r in newest.values() if r[1] >= 700)
    assert "old" not in {r[0] for r in got} and list(CA.combine("symbol", "event_id", 300)(iter([]))) == []
