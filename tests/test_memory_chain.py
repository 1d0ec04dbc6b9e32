"""Appends, consolidation, second encoder and the analysis chain against plain Python."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from glint.operators import chain as C
from glint.operators import memory as M
from glint.operators import models as MD
from glint.operators import retrieval as R
from glint.operators import text_index as T
from glint.sources.memories import read_memories
from glint.streaming import state as ST
from tests.test_plans import plan_of

T0 = dt.datetime(2024, 1, 1)
SCHEMA = ("memory_id long, memory_type string, content string, timestamp timestamp_ntz, importance double, "
          "metadata map<string,string>, context string, emotions array<string>")


def memory_rows(seed, n=150):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        ts = T0 + dt.timedelta(seconds=rng.choice([rng.randint(0, 600), rng.randint(0, 400_000)]))
        out.append((i, rng.choice(["trading_decision", "market_event", "market_event"]), f"text {i}", ts,
                    round(rng.random(), 2), {"symbol": f"S{i % 3}", "importance": "stale"},
                    '{"a": 1}' if i % 4 else None, ["calm", "bold"] if i % 5 == 0 else []))
    return out


def lines_of(rows, kind=None):
    days = {}
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        if kind is None or r[1] == kind:
            days.setdefault((r[1], r[3].date()), []).append(r)
    return {k: v for k, v in days.items() if len(v) >= 2}


@pytest.mark.parametrize("per_piece", [3, 10_000])
def test_consolidation_in_pieces_equals_the_whole_day(spark, per_piece):
    rows = memory_rows(1)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["memory_type"], r["date"]): (r["source_count"], r["importance"], r["content"])
           for r in M.consolidate(df, rows_per_piece=per_piece).collect()}
    want = {k: (len(v), max(r[4] for r in v), "\n".join(f"- {r[2]} (Importance: {r[4]:.4f})" for r in v))
            for k, v in lines_of(rows).items()}
    assert got == want
    one = M.consolidate(df, memory_type="trading_decision", rows_per_piece=per_piece).collect()
    assert {r["date"] for r in one} == {d for _, d in lines_of(rows, "trading_decision")}


def test_summaries_fold_so_that_no_prompt_grows_with_the_day(spark, tmp_path):
    log = str(tmp_path / "prompts")
    rows = [(i, "market_event", f"m{i}", T0 + dt.timedelta(seconds=i), 0.5, {}, None, []) for i in range(400)]

    def first_and_last(prompts):        # keeps the ends of what it is given; the prompts' sizes are written down
        out = []
        for p in prompts:
            lines = [x for x in p.split("\n")[3:] if x][:-1]
            with open(f"{log}-{abs(hash(p))}", "w") as f:
                f.write(str(len(lines)))
            out.append("\n".join([lines[0], lines[-1]]) if len(lines) > 1 else lines[0])
        return out
    summarize = lambda d: MD.enrich(d, "prompt", first_and_last, "summary", "")
    got = M.consolidate(spark.createDataFrame(rows, SCHEMA), summarize, rows_per_piece=20, fan=3).collect()
    assert len(got) == 1 and got[0]["source_count"] == 400
    assert got[0]["content"] == "- m0 (Importance: 0.5000)\n- m399 (Importance: 0.5000)"
    sizes = [int(p.read_text()) for p in tmp_path.glob("prompts-*")]
    assert len(sizes) > 20 and max(sizes) < 60


def test_write_back_is_marked_and_not_consolidated_again(spark, tmp_path):
    path, rows = str(tmp_path / "m"), memory_rows(3)
    MD.append_memories(spark.createDataFrame(rows, SCHEMA), path)
    for _ in range(3):
        ST.consolidate_job(spark, path, memory_type="market_event")
    done = read_memories(spark, path).filter(F.col("metadata")["type"] == "consolidated_memory").collect()
    want = lines_of(rows, "market_event")
    assert sorted(r["timestamp"].date() for r in done) == sorted(d for _, d in want)
    assert all(r["memory_type"] == "market_event" and r["timestamp"].time() == dt.time(0) for r in done)
    assert {r["metadata"]["source_count"] for r in done} == {str(len(v)) for v in want.values()}


def test_append_asks_models_about_new_memories_only(spark, tmp_path):
    path, rows = str(tmp_path / "m"), memory_rows(5, 40)
    rows = [(*r[:4], 1.0, *r[5:]) for r in rows]
    MD.append_memories(spark.createDataFrame(rows, SCHEMA), path, scorer=lambda ps: ["0.25"] * len(ps), dim=4,
                       embedder=lambda ts: [[1.0, 0.0, 0.0, 0.0]] * len(ts))

    def second(prompts):                # a row asked about again would come out as 0.75
        return ["0.75"] * len(prompts)
    more = rows + [(99, "market_event", "new one", T0, 1.0, None, None, None)] * 3
    MD.append_memories(spark.createDataFrame(more, SCHEMA), path, scorer=second, dim=4,
                       embedder=lambda ts: [[0.0, 1.0, 0.0, 0.0]] * len(ts))
    out = read_memories(spark, path).collect()
    assert len(out) == 41 and {r["content"]: r["importance"] for r in out}["new one"] == 0.75
    assert all(r["importance"] == 0.25 for r in out if r["content"] != "new one")
    assert sum(r["embedding"][1] == 1.0 for r in out) == 1


def test_stored_metadata_holds_context_and_emotions(spark, tmp_path):
    path, rows = str(tmp_path / "m"), memory_rows(6, 30)
    MD.append_memories(spark.createDataFrame(rows, SCHEMA), path)
    got = {r["memory_id"]: r["metadata"] for r in read_memories(spark, path).collect()}
    for r in rows:
        m = got[r[0]]
        assert m["symbol"] == r[5]["symbol"] and m["importance"] == str(r[4])
        assert m["timestamp"] == r[3].isoformat()
        assert m.get("context") == r[6]
        assert json.loads(m["emotions"]) == r[7] if r[7] else "emotions" not in m


def test_append_reads_only_the_days_of_the_batch(spark, tmp_path):
    path, rows = str(tmp_path / "m"), memory_rows(7)
    df = spark.createDataFrame(rows, SCHEMA)
    MD.append_memories(df, path)
    batch = MD.with_ids(df.filter(F.col("memory_type") == "market_event").limit(1)).withColumn("day", F.to_date("timestamp"))
    batch = spark.createDataFrame(batch.collect(), batch.schema)
    filters = plan_of(MD.stored_ids(spark, path, batch)).split("PartitionFilters: ")[1].split("\n")[0]
    assert "memory_type" in filters and "day" in filters


def test_encoder_sees_each_distinct_hit_text_once_and_cut(spark, tmp_path):
    docs = spark.createDataFrame([(i, "same words" if i < 5 else f"w{i} " * 900) for i in range(30)], "doc_id long, content string")
    queries = spark.createDataFrame([(0, "same words"), (1, "other"), (9, "not asked")], "query_id long, query string")
    hits = spark.createDataFrame([(0, 1, 3, 0.9), (0, 2, 4, 0.8), (0, 3, 20, 0.7), (1, 1, 3, 0.6)],
                                 "query_id long, rank int, doc_id long, relevance_score double")
    folder = tmp_path / "seen"
    folder.mkdir()
    where = str(folder)

    def encoder(texts):
        import uuid
        with open(f"{where}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(texts))
        return [[float(len(t.split())), float(len(t))] for t in texts]
    cache = str(tmp_path / "vectors")
    first = R.rerank_by_encoder(hits, docs, queries, encoder, 2, cache).collect()
    texts = [x for p in folder.iterdir() for x in p.read_text().split("\n") if x]
    assert sorted(t.split()[0] for t in texts) == ["other", "same", "w20"]
    assert max(len(t.split()) for t in texts) == 512

    def broken(texts):
        raise RuntimeError("no call expected")
    again = R.rerank_by_encoder(hits, docs, queries, broken, 2, cache).collect()
    row = lambda r: (r["query_id"], r["doc_id"], round(r["reranking_score"], 9), r["rerank_rank"])
    assert sorted(map(row, first)) == sorted(map(row, again)) and len(first) == 4
    assert all(r["reranking_score"] == pytest.approx(1.0) for r in first if r["query_id"] == 0 and r["doc_id"] in (3, 4))


def test_fill_embeddings_keeps_stored_vectors(spark):
    df = spark.createDataFrame([(1, "a", [9.0, 9.0]), (2, "b", None), (3, None, None)], "id long, content string, embedding array<float>")
    out = {r["id"]: (list(r["embedding"]), r["vector_source"]) for r in
           MD.fill_embeddings(df, lambda ts: [[float(len(t)), 1.0] for t in ts], dim=2).collect()}
    assert out == {1: ([9.0, 9.0], "stored"), 2: ([1.0, 1.0], "computed"), 3: ([0.0, 1.0], "computed")}
    plain = {r["id"]: list(r["embedding"]) for r in MD.fill_embeddings(df, dim=2).collect()}
    assert plain[1] == [9.0, 9.0] and sum(x * x for x in plain[2]) == pytest.approx(1.0)


def test_chain_text_holds_hits_and_past_decisions(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"Recent trading patterns for S{i % 2} number {i}", [1.0, float(i % 2)]) for i in range(12)],
                                 "doc_id long, content string, embedding array<double>")
    idx = T.build_index(docs, carry=("embedding",))
    symbols = spark.createDataFrame([("S0", 0, [1.0, 0.0]), ("S1", 1, [1.0, 1.0])], "symbol string, symbol_id long, embedding array<double>")
    queries = C.retrieval_queries(symbols, "2024-01-05 10:00:00")
    assert "Normal Trading Hours" in queries.first()["query"]
    hits = C.insights(idx, docs, queries, lambda ts: [[1.0] for _ in ts], 1)
    past = spark.createDataFrame(
        [(i, "trading_decision", json.dumps({"symbol": f"S{i % 2}", "decision": {"recommendation": f"BUY {i}"}}),
          T0 + dt.timedelta(hours=i), 0.5 if i == 2 else 0.9, [1.0, float(i % 2)]) for i in range(6)],
        "memory_id long, memory_type string, content string, timestamp timestamp_ntz, importance double, embedding array<double>")
    remembered = C.remembered(past, symbols, limit=2)
    texts = {r["symbol"]: r["memories_text"] for r in remembered.collect()}
    assert "Decision: BUY 0..." in texts["S0"] and "Decision: BUY 4..." in texts["S0"] and "BUY 2" not in texts["S0"]
    ctx = spark.createDataFrame([(s, T0, 1.0, 1.0, 1.0, 1.0, 0.0, 1.0, 1.0, "UPTREND", 0.5, "LOW", "NORMAL", "POSITIVE") for s in ("S0", "S1", "S2")],
                                "symbol string, timestamp timestamp_ntz, close double, volume double, sma_20 double, sma_50 double, "
                                "z_score double, volume_ratio double, avg_volume_20 double, trend string, trend_strength double, "
                                "volatility_level string, volume_signal string, price_momentum string")
    none = spark.createDataFrame([], "symbol string, news_text string, academic_text string, financial_text string")
    path = str(tmp_path / "m")
    for _ in range(2):
        out = C.run_chain(ctx, none, remembered, hits, "2024-01-05 10:00:00", path,
                          lambda ts: [("HOLD", True) for _ in ts], lambda ts: ["calm, bold" for _ in ts])
    text = {r["symbol"]: r["analysis_text"] for r in out.collect()}
    assert text["S0"].count("\nInsight:\n") >= 1 and "for S0 number" in text["S0"] and "Previous Analysis" in text["S1"]
    assert "No highly relevant historical insights found." in text["S2"] and "Previous Analysis" not in text["S2"]
    stored = read_memories(spark, path).collect()
    assert len(stored) == 3 and all(r["emotions"] == ["calm", "bold"] for r in stored)
    record = json.loads(next(r["content"] for r in stored if r["metadata"]["symbol"] == "S0"))
    assert record["decision"] == {"recommendation": "HOLD", "confidence": True, "sentiment": ["calm", "bold"]}
    assert record["analysis"] == text["S0"] and "Insight" in record["rag_insights"]
    assert {r["symbol"]: r["action"] for r in C.latest_decisions(read_memories(spark, path)).collect()} == {
        "S0": "HOLD", "S1": "HOLD", "S2": "HOLD"}


def test_chain_on_given_tables_has_insights(spark, sf_small):
    from glint.plans.catalog import ORACLE
    from tests.oracle_util import duck

    sql = ORACLE["analysis_chain"]
    n = duck(sf_small).execute(sql.replace(
        "SELECT symbol, length(txt)::BIGINT AS text_length", "SELECT count(*) FILTER (WHERE contains(txt, 'Insight:')) AS n, "
        "count(*) FILTER (WHERE contains(txt, 'Previous Analysis')) AS m FROM t --").split("--")[0]).fetchone()
    assert n[0] > 0 and n[1] > 0
