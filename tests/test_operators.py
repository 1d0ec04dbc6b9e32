"""Operators against brute force on small fixtures, and properties."""

import datetime as dt
import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glint.operators.scoring import bm25_topk
from glint.functions.stem import STOP_WORDS, remove_stop_words
from glint.functions.text import tokenize
from glint.operators import history as H
from glint.operators import memory as M
from glint.operators import retrieval as R
from glint.operators import text_index as T
from glint.operators import vectors as V


def _vectors(spark, n, dim, seed, with_null=True):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = None if (with_null and i % 7 == 3) else [float(x) for x in rng.normal(size=dim)]
        rows.append((i, v))
    return rows, spark.createDataFrame(rows, "item_id long, embedding array<double>")


@pytest.mark.parametrize("metric", ["dot", "cosine", "l2sq"])
def test_block_topk_equals_brute_force(spark, metric):
    items, idf = _vectors(spark, 300, 8, 1)
    qs, qdf = _vectors(spark, 12, 8, 2, with_null=False)
    qdf = qdf.withColumnRenamed("item_id", "query_id")
    got = V.top_k(idf, qdf, 5, metric).collect()
    x = np.array([v if v is not None else [0.0] * 8 for _, v in items])
    for qid, qv in qs:
        q = np.array(qv)
        if metric == "dot":
            s = x @ q
        elif metric == "cosine":
            n = np.linalg.norm(x, axis=1) * np.linalg.norm(q)
            s = np.where(n > 0, (x @ q) / np.where(n > 0, n, 1), 0.0)
        else:
            s = ((x - q) ** 2).sum(1)
        key = np.round(s if metric == "l2sq" else -s, 9)
        want = [int(i) for i in np.lexsort((np.arange(len(s)), key))[:5]]
        mine = [r["item_id"] for r in sorted((r for r in got if r["query_id"] == qid), key=lambda r: r["rank"])]
        assert mine == want


def test_asof_equals_pandas(spark):
    random.seed(5)
    t0 = dt.datetime(2024, 1, 1)
    minutes = random.sample(range(20000), 900)          # distinct times: "last" is well defined
    bars = [("H" if random.random() < 0.6 else "c", t0 + dt.timedelta(minutes=m), float(i))
            for i, m in enumerate(minutes[:600])]
    dec = [("H" if random.random() < 0.6 else "c", t0 + dt.timedelta(minutes=m), i)
           for i, m in enumerate(minutes[600:])]
    dec.append(("H", bars[0][1], 999))                    # same time as a bar: the bar counts
    b = spark.createDataFrame(bars, "symbol string, timestamp timestamp_ntz, close double")
    d = spark.createDataFrame(dec, "symbol string, timestamp timestamp_ntz, decision_id long")
    got = {r["decision_id"]: r["close"] for r in
           H.asof_join(d, b).select("decision_id", "right.close").collect()}
    adaptive = {r["decision_id"]: r["close"] for r in
                H.asof_join(d, b, rows_per_piece=30).select("decision_id", "right.close").collect()}
    assert adaptive == got
    pb = pd.DataFrame(bars, columns=["symbol", "timestamp", "close"]).sort_values("timestamp")
    pd_ = pd.DataFrame(dec, columns=["symbol", "timestamp", "decision_id"]).sort_values("timestamp")
    want = pd.merge_asof(pd_, pb, on="timestamp", by="symbol", direction="backward")
    for _, r in want.iterrows():
        exp = None if pd.isna(r["close"]) else r["close"]
        assert got[r["decision_id"]] == exp


def test_throttle_equals_loop_with_hot_key(spark):
    random.seed(9)
    t0 = dt.datetime(2024, 1, 1)
    rows, t = [], 0
    for i in range(2000):
        t += random.choice([10, 30, 90, 200, 400, 7200])
        rows.append((i, "HOT" if i % 10 else f"s{i % 3}", t0 + dt.timedelta(seconds=t)))
    df = spark.createDataFrame(rows, "id long, symbol string, timestamp timestamp_ntz")
    got = {r["id"] for r in H.throttle(df, gap_seconds=300, chunk_seconds=3600).collect()}
    want, last = set(), {}
    for i, s, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        if s not in last or (ts - last[s]).total_seconds() >= 300:
            want.add(i)
            last[s] = ts
    assert got == want


def test_retention_keeps_newest_five(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"rag_index_{i}.pkl", f"/p/{i}", t0 + dt.timedelta(hours=i % 9), i % 2) for i in range(30)]
    rows.append(("other.txt", "/p/x", t0, 0))
    log = spark.createDataFrame(rows, "name string, path string, mtime timestamp_ntz, series long")
    gone = {r["name"] for r in H.retention(log, 5).collect()}
    for s in (0, 1):
        mine = sorted((r for r in rows if r[3] == s and r[0].endswith(".pkl")), key=lambda r: (-r[2].timestamp(), r[0]))
        assert {r[0] for r in mine[5:]} <= gone and not ({r[0] for r in mine[:5]} & gone)
    assert "other.txt" not in gone


def test_fusion_does_not_depend_on_row_order(spark):
    v = [(1, n, s) for n, s in [(1, 0.9), (2, 0.8), (3, 0.7)]]
    b = [(1, n, s) for n, s in [(3, 2.0), (4, 1.0), (2, 0.1)]]
    schema = "query_id long, node_id long, score double"
    a = R.fuse_nodes(spark.createDataFrame(v, schema), spark.createDataFrame(b, schema)).collect()
    c = R.fuse_nodes(spark.createDataFrame(v[::-1], schema), spark.createDataFrame(b[::-1], schema)).collect()
    key = lambda rows: [(r["rank"], r["node_id"], round(r["score"], 12)) for r in rows]
    assert sorted(key(a)) == sorted(key(c))
    top = {r["node_id"]: r["score"] for r in a}
    assert top[3] == pytest.approx(0.7 * 0.7 + 0.3 * 2.0) and top[4] == 1.0


from tests.test_snowball import plain  # noqa: E402


def _brute_bm25(docs, queries, plus1, stem):
    def toks(t):
        import regex
        out = regex.findall(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]", t.lower())
        if stem:
            out = [plain(w) for w in out if w not in STOP_WORDS]
        return out
    dt_ = {i: toks(t) for i, t in docs}
    n = len(dt_)
    avg = sum(len(v) for v in dt_.values()) / n
    df = Counter(w for v in dt_.values() for w in set(v))
    if plus1:
        idf = {w: math.log(1 + (n - c + 0.5) / (c + 0.5)) for w, c in df.items()}
    else:
        raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
        floor = 0.25 * sum(raw.values()) / len(raw)
        idf = {w: (floor if r < 0 else r) for w, r in raw.items()}
    out = {}
    for qid, q in queries:
        for d, v in dt_.items():
            tf = Counter(v)
            s, shared = 0.0, False
            for w in toks(q):
                if w in tf:
                    shared = True
                    k = 1.5 * (0.25 + 0.75 * len(v) / avg)
                    s += idf[w] * tf[w] * (1.0 if plus1 else 2.5) / (tf[w] + k)
            if shared:                       # every document sharing a term is listed
                out[(qid, d)] = s
    return out


WORDS = "the market rallied rallies strongly strong trading traded trader volume volumes price prices fell falling".split()


@pytest.mark.parametrize("plus1,stem", [(False, False), (True, True)])
def test_bm25_equals_brute_force(spark, plus1, stem):
    random.seed(11)
    docs = [(i, " ".join(random.choice(WORDS) for _ in range(random.randint(0, 25)))) for i in range(60)]
    queries = [(q, " ".join(random.choice(WORDS) for _ in range(4))) for q in range(5)]
    d = spark.createDataFrame(docs, "doc_id long, content string")
    q = spark.createDataFrame(queries, "query_id long, query string")
    tokens = "tokens" if stem else None
    if stem:
        d = d.withColumn("tokens", remove_stop_words(tokenize("content")))
        q = q.withColumn("tokens", remove_stop_words(tokenize("query")))
    idx = T.build_index(d, variant="plus1" if plus1 else "okapi", tokens=tokens, stems=stem)
    got = bm25_topk(idx, q, 1000, query_tokens=tokens, stems=stem).collect()
    want = _brute_bm25(docs, queries, plus1, stem)
    mine = {(r["query_id"], r["doc_id"]): r["bm25"] for r in got}
    assert set(mine) == set(want)
    for k, v in want.items():
        assert mine[k] == pytest.approx(v, rel=1e-9, abs=1e-12)


def test_index_save_load_same_scores(spark, tmp_path):
    from glint.sources.index_store import load_latest, save_index
    docs = spark.createDataFrame([(i, " ".join(WORDS[i % 7: i % 7 + 5])) for i in range(40)], "doc_id long, content string")
    q = spark.createDataFrame([(0, "market price"), (1, "strong trading volume")], "query_id long, query string")
    idx = T.build_index(docs)
    before = sorted(tuple(r) for r in bm25_topk(idx, q, 100).collect())
    save_index(idx, str(tmp_path), "a", mtime=dt.datetime(2024, 1, 1))
    save_index(T.build_index(docs.limit(3)), str(tmp_path), "b", mtime=dt.datetime(2023, 1, 1))  # older
    after = sorted(tuple(r) for r in bm25_topk(load_latest(spark, str(tmp_path)), q, 100).collect())
    assert [r[:3] for r in before] == [r[:3] for r in after]
    assert [r[3] for r in before] == pytest.approx([r[3] for r in after], rel=1e-12)  # sum order may differ


def test_memory_stats_zero_filled_and_consolidate_twice(spark):
    t0 = dt.datetime(2024, 1, 1, 10)
    rows = [(1, "market_event", "a", t0, 0.8), (2, "market_event", "b", t0 + dt.timedelta(hours=1), 0.2),
            (3, "trading_decision", "c", t0, 0.9)]
    m = spark.createDataFrame(rows, "memory_id long, memory_type string, content string, "
                                    "timestamp timestamp_ntz, importance double") \
        .withColumn("metadata", F.create_map(F.lit("symbol"), F.lit("X")))
    stats = {r["memory_type"]: (r["count"], r["avg_importance"], r["high_importance_count"])
             for r in M.memory_stats(m).collect()}
    assert stats == {"market_event": (2, 0.5, 1), "trading_decision": (1, 0.9, 1),
                     "research_insight": (0, 0.0, 0), "performance_metric": (0, 0.0, 0)}
    c1 = M.consolidate(m).select("memory_type", "source_count", "importance", "content").collect()
    c2 = M.consolidate(m).select("memory_type", "source_count", "importance", "content").collect()
    assert c1 == c2 and len(c1) == 1                      # one memory on a date: not consolidated
    assert c1[0]["content"] == "- a (Importance: 0.8000)\n- b (Importance: 0.2000)"


@pytest.mark.parametrize("chunk", [600, 3600])
def test_throttle_dense_stream_without_pauses(spark, chunk):
    """No gap ever reaches the throttle gap, so the whole history is one run: it must
    still be split over chunks and give the plain loop's answer (ties included)."""
    random.seed(21)
    t0 = dt.datetime(2024, 1, 1)
    rows, t = [], 0
    for i in range(3000):
        t += random.choice([0, 7, 20, 45, 90, 180, 299])
        rows.append((i, "HOT" if i % 7 else "cold", t0 + dt.timedelta(seconds=t)))
    df = spark.createDataFrame(rows, "id long, symbol string, timestamp timestamp_ntz")
    got = {r["id"] for r in H.throttle(df, gap_seconds=300, chunk_seconds=chunk).collect()}
    want, last = set(), {}
    for i, s, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        if s not in last or (ts - last[s]).total_seconds() >= 300:
            want.add(i)
            last[s] = ts
    assert got == want


def test_throttle_ignores_session_time_zone(spark):
    """Wall-clock times across a daylight-saving change keep their gaps."""
    t0 = dt.datetime(2024, 3, 10, 1, 0)
    rows = [(i, "A", t0 + dt.timedelta(minutes=4 * i)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, symbol string, timestamp timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        got = {r["id"] for r in H.throttle(df, gap_seconds=300, chunk_seconds=1800).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    want, last = set(), None
    for i, _, ts in rows:
        if last is None or (ts - last).total_seconds() >= 300:
            want.add(i)
            last = ts
    assert got == want



def test_throttle_adaptive_chunks(spark):
    """Chunk length from the data (about 40 rows per chunk here)."""
    random.seed(44)
    t0 = dt.datetime(2024, 1, 1)
    rows, t = [], 0
    for i in range(2500):
        t += random.choice([0, 5, 30, 100, 250, 299, 310, 4000])
        rows.append((i, "HOT" if i % 9 else "c", t0 + dt.timedelta(seconds=t)))
    df = spark.createDataFrame(rows, "id long, symbol string, timestamp timestamp_ntz")
    got = {r["id"] for r in H.throttle(df, gap_seconds=300, rows_per_chunk=40).collect()}
    want, last = set(), {}
    for i, s, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        if s not in last or (ts - last[s]).total_seconds() >= 300:
            want.add(i)
            last[s] = ts
    assert got == want


def test_asof_bursts_ties_and_handed_rows(spark):
    """Most rows in one burst, many rows of equal time, keys without right rows, pieces without right rows."""
    random.seed(12)
    t0 = dt.datetime(2024, 1, 1)
    at = lambda: t0 + dt.timedelta(seconds=random.choice([random.randint(0, 30), random.randint(0, 100_000)]))
    left = [(i, random.choice(["HOT", "HOT", "HOT", "a", "none"]), at()) for i in range(600)]
    right = [(i, random.choice(["HOT", "a", "b"]), at(), float(i)) for i in range(150)]
    ld = spark.createDataFrame(left, "id long, symbol string, timestamp timestamp_ntz")
    rd = spark.createDataFrame(right, "rid long, symbol string, timestamp timestamp_ntz, close double")
    want = {}
    for i, s, t in left:
        best = max(((r[2], r[0]) for r in right if r[1] == s and r[2] <= t), default=None)
        want[i] = best and best[1]
    for rows in (7, 40, 1_000_000):
        got = {r["id"]: r["rid"] for r in H.asof_join(ld, rd, rows_per_piece=rows, tie="rid").select("id", "right.rid").collect()}
        assert got == want


def test_pieces_split_a_burst_by_rows(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("HOT", t0 + dt.timedelta(microseconds=i)) for i in range(4000)] + [("HOT", t0 + dt.timedelta(days=d)) for d in range(1, 90)]
    df = spark.createDataFrame(rows + [("b", t0)], "symbol string, timestamp timestamp_ntz")
    sizes = {(r["symbol"], r["_c"]): r["n"] for r in H.with_pieces(df, "symbol", "timestamp", 500).groupBy(
        "symbol", "_c").agg(F.count("*").alias("n")).collect()}
    hot = [n for (s, _), n in sizes.items() if s == "HOT"]
    assert len(hot) >= 8 and max(hot) <= 700 and sum(hot) == 4089
    spans = H.with_pieces(df, "symbol", "timestamp", 500).groupBy("symbol", "_c").agg(
        F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")).filter("symbol = 'HOT'").orderBy("_c").collect()
    assert all(x["hi"] < y["lo"] for x, y in zip(spans, spans[1:], strict=False))


def test_asof_shuffles_each_side_once(spark, sf_small):
    from glint.plans.catalog import QUERIES
    from tests.test_plans import plan_of

    tree = plan_of(QUERIES["asof_context"](spark, sf_small)).split("\n\n")[0]
    assert tree.count("Scan parquet") <= 4 and ("ReusedExchange" in tree or tree.count("Exchange (") <= 4)
