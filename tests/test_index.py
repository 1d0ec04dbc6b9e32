"""Index build, block bounds, delta refresh and hybrid scans against brute force; plans of what is new."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glint.operators import bm25 as BM
from glint.operators import scoring as SCO
from glint.operators import text_index as T
from glint.sources import index_table as IT
from tests.test_plans import plan_of

WORDS = [f"w{i}" for i in range(40)]


def corpus(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        some = rng.sample(WORDS, rng.randint(1, 12))
        rows.append((i, " ".join(rng.choice(some) for _ in range(rng.randint(0, 40)))))
    return rows + [(n, None), (n + 1, ""), (n + 2, "common " * 300)] + [(n + 3 + i, "common copy") for i in range(60)]


def brute_scores(rows, query, avgdl=None):
    toks = {i: (t or "").split() for i, t in rows}
    n = len(toks)
    avgdl = sum(map(len, toks.values())) / n
    df = Counter(w for v in toks.values() for w in set(v))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: floor if r < 0 else r for w, r in raw.items()}
    out = {}
    for i, v in toks.items():
        tf = Counter(v)
        found = [w for w in query.split() if w in tf]
        if found:
            out[i] = sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(v) / avgdl)) for w in found)
    return out


def test_counts_in_place(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["x"])], "doc_id long, t array<string>")
    got = {r["doc_id"]: (r["dl"], r["terms"], r["tfs"]) for r in T.forward_rows(df, tokens="t").collect()}
    assert got == {1: (3, ["a", "b"], [1, 2]), 2: (0, [], []), 3: (0, [], []), 4: (1, ["x"], [1])}


def test_index_build_shuffles_only_document_frequencies(spark):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b "), F.col("id")).alias("content"))
    assert "Exchange" not in plan_of(T.forward_rows(docs))
    assert "Python" not in plan_of(T.forward_rows(docs))


@pytest.mark.parametrize("search", [BM.bm25_join, SCO.bm25_topk])
@pytest.mark.parametrize("k", [1, 5, 1000])
def test_topk_equals_brute_force(spark, monkeypatch, k, search):
    monkeypatch.setattr(BM, "LEADING", 2)
    monkeypatch.setattr(SCO, "QUERIES_PER_BLOCK", 5)
    monkeypatch.setattr(SCO, "ROWS_AT_ONCE", 30)
    rng = random.Random(k)
    rows = corpus(4)
    queries = [(q, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 6)))) for q in range(12)]
    queries += [(50, "common"), (51, "unknown words"), (52, ""), (53, "w1 w1 w1 common copy")]
    idx = T.build_index(spark.createDataFrame(rows, "doc_id long, content string"))
    got = search(idx, spark.createDataFrame(queries, "query_id long, query string"), k).collect()
    mine = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        mine.setdefault(r["query_id"], []).append((r["doc_id"], r["bm25"]))
    for q, text in queries:
        want = sorted(brute_scores(rows, text).items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
        assert [d for d, _ in mine.get(q, [])] == [d for d, _ in want]
        assert [s for _, s in mine.get(q, [])] == pytest.approx([s for _, s in want], abs=1e-9)


def test_bounds_hold_and_common_words_are_left_aside(spark):
    text = "rare1 rare2 rare3 w1 w2 common"
    rows = corpus(9) + [(9000 + i, "rare1 rare2 rare3") for i in range(12)]
    idx = T.build_index(spark.createDataFrame(rows, "doc_id long, content string"))
    q = spark.createDataFrame([(1, text)], "query_id long, query string")
    weights = BM.query_weights(idx, T.query_terms(q)).persist()
    assert weights.agg(F.sum("most")).first()[0] >= max(brute_scores(rows, text).values())
    for r in weights.collect():
        assert r["most"] >= max(brute_scores(rows, r["term"]).values()) - 1e-9
    first = BM.thresholds(BM.scores_of(idx, weights.filter("term like 'rare%'")), weights, 5)
    split = BM.split_terms(weights, first)
    assert {r["term"] for r in split.filter("aside").collect()} >= {"common"}
    partial = BM.scores_of(idx, split.filter("NOT aside"))
    left = {r["doc_id"] for r in BM.survivors(partial, split, 5).collect()}
    scores = brute_scores(rows, text)
    assert set(sorted(scores, key=lambda d: (-scores[d], d))[:5]) <= left
    assert len(left) < len(scores) / 2


def test_scores_are_joins_without_python(spark):
    idx = T.build_index(spark.range(50).select(F.col("id").alias("doc_id"), F.lit("a b").alias("content")))
    q = spark.range(3).select(F.col("id").alias("query_id"), F.lit("a").alias("query"))
    plan = plan_of(BM.bm25_join(idx, q, 3))
    assert "InPandas" not in plan and "InArrow" not in plan and "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def stats(idx):
    return idx.n_docs, idx.avgdl, sorted((r["term"], r["df"], round(r["idf"], 9)) for r in idx.terms.collect())


def test_delta_refresh_equals_new_index(spark, tmp_path):
    base = str(tmp_path / "ix")
    frame = lambda d: spark.createDataFrame(sorted(d.items()), "doc_id long, content string")
    now = dict(corpus(2, 120))
    IT.create(frame(now), base)
    rng = random.Random(5)
    for step in range(4):
        changed = {rng.randint(0, 200): " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 9))) for _ in range(25)}
        removed = {rng.randint(0, 220): "" for _ in range(10)}
        IT.refresh(spark, base, frame(changed), frame(removed) if step != 2 else None)
        if step != 2:
            now = {i: t for i, t in now.items() if i not in removed}
        now |= changed
    got, want = IT.load(spark, base), T.build_index(frame(now))
    assert stats(got) == stats(want)
    rows = lambda i: sorted((r["doc_id"], r["dl"], r["terms"], r["tfs"]) for r in i.forward.collect())
    assert rows(got) == rows(want)
    q = spark.createDataFrame([(1, "w1 w2 w3"), (2, "common copy")], "query_id long, query string")
    top = lambda i: [tuple(r)[:3] for r in BM.bm25_join(i, q, 7).orderBy("query_id", "rank").collect()]
    assert top(got) == top(want)
    IT.compact(spark, base, str(tmp_path / "one"))
    assert stats(IT.load(spark, str(tmp_path / "one"))) == stats(want)


def test_refresh_reads_the_buckets_of_changed_documents(spark, tmp_path):
    base = str(tmp_path / "ix")
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("a "), F.col("id")).alias("content"))
    IT.create(docs, base)
    former = IT.former_rows(spark, base, docs.filter("doc_id = 7"), 1)
    only = docs.filter("doc_id = 7").select(IT._bucket()).first()[0]
    pruned = plan_of(former).split("PartitionFilters: [")[1].split("\n")[0]
    assert "bucket" in pruned and f"= {only})" in pruned
    assert [r["doc_id"] for r in former.collect()] == [7]


def test_replaying_the_same_refresh_changes_nothing(spark, tmp_path):
    base = str(tmp_path / "ix")
    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.lit("x y").alias("content"))
    IT.create(docs, base)
    new = docs.filter("doc_id < 3").withColumn("content", F.lit("z"))
    IT.refresh(spark, base, new)
    once = stats(IT.load(spark, base))
    IT.refresh(spark, base, new)
    assert stats(IT.load(spark, base)) == once


def test_hybrid_scan_with_windows_equals_brute_force(spark, monkeypatch):
    import datetime as dt

    monkeypatch.setattr(SCO, "QUERIES_PER_BLOCK", 3)
    monkeypatch.setattr(SCO, "ROWS_AT_ONCE", 11)
    monkeypatch.setattr(SCO, "EXPAND_LIMIT", 13)
    rng = random.Random(6)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t or "", None if i % 9 == 4 else t0 + dt.timedelta(hours=rng.randint(0, 200)),
             None if i % 7 == 2 else [rng.gauss(0, 1) for _ in range(4)]) for i, t in corpus(7, 150)]
    docs = spark.createDataFrame(rows, "doc_id long, content string, timestamp timestamp_ntz, embedding array<double>")
    idx = T.build_index(docs, carry=("timestamp", "embedding"))
    queries = []
    for q in range(10):
        a = t0 + dt.timedelta(hours=rng.randint(0, 150))
        window = [(None, None), (a, None), (None, a), (a, a + dt.timedelta(hours=30))][q % 4]
        queries.append((q, " ".join(rng.choice(WORDS) for _ in range(3)), [rng.gauss(0, 1) for _ in range(4)], *window))
    frame = spark.createDataFrame(queries, "query_id long, query string, embedding array<double>, "
                                           "start timestamp_ntz, end timestamp_ntz")
    got = {}
    for r in SCO.hybrid_topk(idx, None, frame, 4, min_relevance=-9.0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["doc_id"], r["relevance_score"])
    texts = [(i, t) for i, t, _, _ in rows]
    for q, text, vec, start, end in queries:
        inside = [r for r in rows if (start is None or (r[2] and r[2] >= start)) and (end is None or (r[2] and r[2] <= end))]
        bm = brute_scores(texts, text)
        score = {}
        b = {r[0]: bm.get(r[0], 0.0) for r in inside}
        s = {r[0]: float(np.dot(vec, r[3])) if r[3] else 0.0 for r in inside}
        mb, ms = max(b.values(), default=0), max(s.values(), default=0)
        for d in b:
            score[d] = 0.4 * (b[d] / mb if mb > 0 else 0) + 0.6 * (s[d] / ms if ms > 0 else 0)
        want = sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:4]
        mine = [got.get(q, {})[n + 1] for n in range(len(got.get(q, {})))]
        assert [d for d, _ in mine] == [d for d, _ in want]
        assert [x for _, x in mine] == pytest.approx([x for _, x in want], abs=1e-9)


def test_window_reaches_the_scan_and_nothing_is_multiplied(spark, sf_small):
    import contextlib
    import io

    from glint.plans import bindings as B
    from glint.plans.q_retrieval import WINDOW, _index

    idx = _index(spark, sf_small)
    at = [np.datetime64(x.replace(" ", "T")).astype("datetime64[us]").astype(float) for x in WINDOW]
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        SCO.documents_between(idx.forward, *at).select("doc_id", "terms").explain(mode="formatted")
    assert "GreaterThanOrEqual(timestamp" in out.getvalue() and "LessThanOrEqual(timestamp" in out.getvalue()
    q = B.queries(spark, sf_small)
    plan = plan_of(SCO.hybrid_topk(idx, None, q, 5))
    assert "Generate" not in plan and "CoGroup" not in plan        # no explode by block, no grouping of items
    assert plan.count("Exchange (") <= 1 + plan.count("MapInPandas (") - 1       # only the few best rows are shuffled


def test_broadcast_is_bounded_by_bytes(spark):
    df = spark.range(1000).select(F.col("id"), F.repeat(F.lit("x"), 1000).alias("s"))
    small, big = T.bounded_broadcast(df, 4 << 20), T.bounded_broadcast(df, 100_000)
    other = spark.range(10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan_of(other.join(small, "id"))
        assert "BroadcastHashJoin" not in plan_of(other.join(big, "id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_postings_of_the_vocabulary_reach_the_scores(spark):
    """Terms that no query asks for stay in Arrow; rows without any posting stay rows."""
    rows = [(1, 3, ["a", "b", "c"], [2, 1, 5]), (2, 0, [], []), (3, 2, ["x", "y"], [1, 1]), (4, 1, ["c"], [7])]
    df = spark.createDataFrame(rows, "doc_id long, dl int, terms array<string>, tfs array<long>").coalesce(1)
    held = spark.sparkContext.broadcast(np.array(["c", "a"], dtype=object))
    got = {r["doc_id"]: (r["dl"], r["codes"], r["tfs"]) for r in SCO.coded(df, held).collect()}
    assert got == {1: (3, [1, 0], [2, 5]), 2: (0, [], []), 3: (2, [], []), 4: (1, [0], [7])}


def test_terms_of_many_queries_equal_terms_of_few(spark, monkeypatch):
    """Common terms as a matrix product, rare ones expanded: the same hits either way."""
    rows = corpus(5, 120)
    docs = spark.createDataFrame(rows, "doc_id long, content string")
    q = spark.createDataFrame([(i, f"common w1 w2 w{i % 40} w3 w3") for i in range(40)], "query_id long, query string")
    idx = T.build_index(docs)
    found = []
    for often in (1, 10_000):
        monkeypatch.setattr(SCO, "OFTEN", often)
        found.append([(r["query_id"], r["rank"], r["doc_id"], round(r["bm25"], 9)) for r in SCO.bm25_topk(idx, q, 4).orderBy("query_id", "rank").collect()])
    assert found[0] == found[1] and len(found[0]) == 160


def test_hits_are_searched_once_for_the_second_encoder(spark):
    """The re-ranking names the hits three times; the search behind them runs once."""
    from glint.operators import retrieval as R
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf
    hits = spark.createDataFrame([(1, 1, 10, 0.9), (1, 2, 11, 0.8)], "query_id long, rank int, doc_id long, relevance_score double")
    docs = spark.createDataFrame([(10, "a b"), (11, "c")], "doc_id long, content string")
    q = spark.createDataFrame([(1, "a b")], "query_id long, query string")
    got = R.rerank_by_encoder(hits.mapInPandas(count, hits.schema), docs, q).collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rerank_rank"])] == [10, 11] and seen.value == 2


def test_scores_of_a_document_are_added_where_its_postings_lie(spark):
    idx = T.build_index(spark.createDataFrame(corpus(3), "doc_id long, content string"))
    q = spark.createDataFrame([(1, "w1 w2 common"), (2, "common")], "query_id long, query string")
    weights = BM.query_weights(idx, T.query_terms(q)).persist()
    plan = plan_of(BM.scores_of(idx, weights))
    assert "hashpartitioning(doc_id" in plan
    assert not re.search(r"hashpartitioning\(query_id#\w+, doc_id", plan)           # no pair is exchanged


def test_tokens_of_a_text_are_sorted_without_a_comparing_function(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, None), (3, "")], "doc_id long, content string")
    rows = T.forward_rows(docs)
    assert "sort_array(" in rows._jdf.queryExecution().analyzed().toString()
    assert [(r["dl"], r["terms"], r["tfs"]) for r in rows.orderBy("doc_id").collect()] == [
        (3, ["a", "b"], [1, 2]), (0, [], []), (0, [], [])]
    listed = spark.createDataFrame([(1, ["b", None, "a"])], "doc_id long, t array<string>")
    assert T.forward_rows(listed, tokens="t").first()["terms"] == ["a", "b"]


@pytest.mark.parametrize("broad", [-1.0, 1e9])
def test_broad_queries_are_scored_in_the_pass_of_the_partial_scores(spark, monkeypatch, broad):
    monkeypatch.setattr(BM, "BROAD", broad)
    rows = corpus(9) + [(9000 + i, "rare1 rare2 rare3 w1") for i in range(12)]
    text = "rare1 rare2 rare3 w1 w2 common"
    idx = T.build_index(spark.createDataFrame(rows, "doc_id long, content string"))
    got = BM.bm25_join(idx, spark.createDataFrame([(1, text)], "query_id long, query string"), 5).orderBy("rank").collect()
    want = sorted(brute_scores(rows, text).items(), key=lambda x: (-round(x[1], 9), x[0]))[:5]
    assert [r["doc_id"] for r in got] == [d for d, _ in want]
    assert [r["bm25"] for r in got] == pytest.approx([s for _, s in want], abs=1e-9)
