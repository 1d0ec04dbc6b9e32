"""Many queries of one form: scored together, with the same result as block by block and as in plain Python."""

import math
import random

import numpy as np
import pytest

from glint.functions.text import tokenize
from glint.operators import alike as AL
from glint.operators import scoring as SCO
from glint.operators import text_index as T
from glint.operators import vectors as V

WORDS = ["market", "trend", "trading", "patterns", "recent", "context", "the", "of", "symbol", "price"]


def tables(spark, seed, n_docs=150, n_queries=70):
    rng = random.Random(seed)
    vec = lambda: [round(rng.gauss(0, 1), 3) for _ in range(4)]
    docs = []
    for i in range(n_docs):
        text = " ".join(rng.choices(WORDS + [str(x) for x in range(0, n_queries, 3)], k=rng.randint(0, 12)))
        docs.append((i, text, None if i % 3 == 0 else vec()))
    docs += [(n_docs + i, t, v) for i, (_, t, v) in enumerate(docs[:20])]      # copies tie, and the id decides
    queries = [(i, f"Symbol: {i}\nQuery: recent trading patterns and market context for {i}", None if i % 7 == 0 else vec())
               for i in range(n_queries)]
    d = spark.createDataFrame(docs, "doc_id long, content string, embedding array<double>")
    q = spark.createDataFrame(queries, "query_id long, query string, embedding array<double>")
    return docs, queries, T.build_index(d, carry=("embedding",)), q


def tokens(spark, rows):
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "i long, t string")
    return {r["i"]: r["t"] for r in df.select("i", tokenize("t").alias("t")).collect()}


def plain(spark, docs, queries, k, least):
    toks, asked = tokens(spark, docs), tokens(spark, queries)
    n, avgdl = len(docs), sum(map(len, toks.values())) / len(docs)
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    idf = {w: 0.25 * sum(raw.values()) / len(raw) if x < 0 else x for w, x in raw.items()}
    out = {}
    for q, _, qv in queries:
        bm = {d: sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avgdl)) for w in asked[q] if w in t and w in idf)
              for d, t in toks.items()}
        sem = {d: 0.0 if v is None or qv is None else float(np.dot(qv, v)) for d, _, v in docs}
        mb, ms = max(bm.values()), max(sem.values())
        score = {d: 0.4 * (bm[d] / mb if mb > 0 else 0) + 0.6 * (sem[d] / ms if ms > 0 else 0) for d in bm}
        best = sorted(score, key=lambda d: (-round(score[d], 9), d))[:k]
        out |= {(q, i): (d, round(score[d], 7)) for i, d in enumerate(best, 1) if score[d] >= least}
    return out


def found(df):
    return {(r["query_id"], r["rank"]): (r["doc_id"], round(r["relevance_score"], 7)) for r in df.collect()}


@pytest.mark.parametrize("least", [0.5, -1.0])
def test_queries_of_one_form_equal_plain_python(spark, monkeypatch, least):
    docs, queries, index, q = tables(spark, 3)
    monkeypatch.setattr(AL, "RARELY", 1)
    monkeypatch.setattr(AL, "ROWS_AT_ONCE", 7)
    monkeypatch.setattr(AL, "CELLS_AT_ONCE", 60)
    monkeypatch.setattr(AL, "KEPT_AT_ONCE", 50)
    used, alike = [], SCO.alike_topk
    monkeypatch.setattr(SCO, "alike_topk", lambda *a: used.append(1) or alike(*a))
    got = found(SCO.hybrid_topk(index, None, q, 5, least))
    assert used == [1] and got == plain(spark, docs, queries, 5, least)
    monkeypatch.setattr(SCO, "alike_queries", lambda *a: None)
    assert got == found(SCO.hybrid_topk(index, None, q, 5, least))


def test_queries_of_one_form_within_windows(spark, monkeypatch):
    docs, _, index, q = tables(spark, 5)
    day = lambda c: f"timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, {c})"
    index.forward = index.forward.selectExpr("*", f"{day('doc_id')} AS timestamp")
    q = q.selectExpr("*", f"{day('40 * (query_id % 3)')} AS start", f"if(query_id % 3 = 2, NULL, {day('40 * (query_id % 3) + 60')}) AS end")
    monkeypatch.setattr(AL, "RARELY", 1)
    used, alike = [], SCO.alike_topk
    monkeypatch.setattr(SCO, "alike_topk", lambda *a: used.append(1) or alike(*a))
    got = found(SCO.hybrid_topk(index, None, q, 4, 0.3))
    assert used == [1] and {d for (i, _), (d, _) in got.items() if i % 3 == 1} <= set(range(40, 101)) and got
    monkeypatch.setattr(SCO, "alike_queries", lambda *a: None)
    assert got == found(SCO.hybrid_topk(index, None, q, 4, 0.3))


def test_the_index_is_read_once_for_many_queries_of_one_form(spark, monkeypatch):
    _, _, index, q = tables(spark, 4)
    monkeypatch.setattr(AL, "RARELY", 1)
    monkeypatch.setattr(SCO, "QUERIES_PER_BLOCK", 5)
    reads, coded = [], SCO.coded
    monkeypatch.setattr(SCO, "coded", lambda *a: reads.append(1) or coded(*a))
    SCO.hybrid_topk(index, None, q, 5).count()
    assert len(reads) == 1


def test_a_query_that_comes_twice_gets_its_documents_twice(spark, monkeypatch):
    monkeypatch.setattr(AL, "RARELY", 1)
    _, _, index, q = tables(spark, 6)
    once = found(SCO.hybrid_topk(index, None, q, 2, 0.4))
    twice = found(SCO.hybrid_topk(index, None, q.unionByName(q), 4, 0.4))
    assert twice == {(i, 2 * r - m): d for (i, r), d in once.items() for m in (0, 1)} and once


def test_queries_that_differ_stay_in_blocks(spark):
    rng = random.Random(1)
    asked = [AL.Asked(i, None, np.nan, np.nan, np.array(rng.sample(range(40), 12)), np.ones(12)) for i in range(64)]
    assert AL.alike_queries(asked, [5] * 40, 100_000, 9.0, 2.5) is None


@pytest.mark.parametrize("metric", ["l2sq", "dot", "cosine"])
def test_scan_by_products_keeps_ties_and_places(spark, monkeypatch, metric):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 5)).round(2)
    x[60:90], x[90:] = x[:30], 1000 + x[:30]                # copies, and vectors far off whose products round coarsely
    q = np.concatenate([x[:10], rng.normal(size=(10, 5)), x[100:105]])
    for name, value in (("ROWS_AT_ONCE", 17), ("CELLS_AT_ONCE", 50), ("PAIRS_AT_ONCE", 30), ("QUERIES_PER_BLOCK", 9)):
        monkeypatch.setattr(V, name, value)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, embedding array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["item_id"] for r in V.top_k(items, asked, 4, metric).collect()}
    for i, v in enumerate(q):
        s = V.scores(v[None], x, metric)[0] * (1 if metric == "l2sq" else -1)
        want = sorted(range(len(x)), key=lambda j: (round(s[j], 9), j))[:4]
        assert [got[i, r] for r in (1, 2, 3, 4)] == want
