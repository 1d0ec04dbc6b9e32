"""Vector scans and stored cells against brute force; which cells are read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glint.operators import vectors as V
from tests.test_plans import plan_of


def tables(spark, seed, n=600, dim=5, near=6):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(near, dim)) * 6
    rows = [(i, None if i % 41 == 7 else (middle[rng.integers(near)] + rng.normal(size=dim) * 0.4).tolist(), i % 3)
            for i in range(n)]
    rows += [(n + i, middle[0].tolist(), 1) for i in range(n // 2)] + [(5000, [0.0] * dim, 0)]      # one vector, many times
    q = [(i, (middle[i % near] + rng.normal(size=dim) * 0.3).tolist()) for i in range(9)] + [(77, [0.0] * dim)]
    return rows, q, spark.createDataFrame(rows, "item_id long, embedding array<double>, kind int").repartition(7), \
        spark.createDataFrame(q, "query_id long, embedding array<double>")


def brute(rows, queries, k, metric, kinds=(0, 1, 2)):
    out = {}
    for qid, q in queries:
        found = []
        for i, v, kind in rows:
            if kind in kinds:
                x = np.zeros(len(q)) if v is None else np.array(v)
                if metric == "l2sq":
                    s = float(((x - q) ** 2).sum())
                elif metric == "dot":
                    s = float(x @ q)
                else:
                    n = np.linalg.norm(x) * np.linalg.norm(q)
                    s = float(x @ q / n) if n > 0 else 0.0
                found.append((s if metric == "l2sq" else -s, i, s))
        found.sort(key=lambda t: (round(t[0], 9), t[1]))
        out[qid] = [(i, round(s, 8)) for _, i, s in found[:k]]
    return out


def listed(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["item_id"], round(r["score"], 8)))
    return out


@pytest.mark.parametrize("metric", ["dot", "cosine", "l2sq"])
def test_scan_and_cells_equal_brute_force(spark, tmp_path, monkeypatch, metric):
    monkeypatch.setattr(V, "QUERIES_PER_BLOCK", 4)
    monkeypatch.setattr(V, "ROWS_AT_ONCE", 50)
    rows, q, items, queries = tables(spark, 3)
    want = brute(rows, q, 6, metric)
    assert listed(V.top_k(items, queries, 6, metric)) == want
    path = V.build_cells(items, str(tmp_path / metric), metric, cells=12, carry=("kind",))
    assert listed(V.search_cells(spark, path, queries, 6, metric)) == want
    kept = V.search_cells(spark, path, queries, 6, metric, F.col("kind") == 1)
    assert listed(kept) == brute(rows, q, 6, metric, (1,))


def test_all_items_when_there_are_few(spark, tmp_path):
    rows, q, items, queries = tables(spark, 5, n=20)
    path = V.build_cells(items, str(tmp_path / "c"), "l2sq", cells=4)
    assert listed(V.search_cells(spark, path, queries, 500)) == brute(rows, q, 500, "l2sq")


def test_far_cells_are_not_read(spark, tmp_path):
    rows, q, items, queries = tables(spark, 8)
    path = V.build_cells(items, str(tmp_path / "c"), "l2sq", cells=12)
    report = []
    V.search_cells(spark, path, queries.filter("query_id < 9"), 3, report=report)
    done, of = map(sum, zip(*report, strict=True))
    assert done < of / 2
    assert spark.read.parquet(f"{path}/items").count() == len(rows)


def test_bound_is_never_worse_than_a_score():
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(300, 4)), rng.normal(size=(20, 4))
    pivots = V.fit_pivots(x, 9)
    for metric in ("l2sq", "dot", "cosine"):
        y = V._unit(x) if metric == "cosine" else x
        cell, away = V.nearest(y, pivots)
        radius = np.array([away[cell == c].max() for c in range(9)])
        bound = V.reachable(q, pivots, radius, metric)
        key = V.scores(q, x, metric) * (1 if metric == "l2sq" else -1)
        for c in range(9):
            assert (bound[:, [c]] <= key[:, cell == c] + 1e-9).all()


def test_items_are_not_shuffled_and_cells_are_pruned(spark, tmp_path):
    _, _, items, queries = tables(spark, 2)
    flat = str(tmp_path / "flat")
    items.write.parquet(flat)
    plan = plan_of(V.top_k(spark.read.parquet(flat), queries, 4))
    tree = plan.split("\n\n")[0]
    below = tree.split("MapInPandas (")[1]                  # what feeds the scan
    assert "Scan parquet" in below and "Exchange" not in below
    assert "Generate" not in tree and "CoGroup" not in tree
    path = V.build_cells(items, str(tmp_path / "c"), "l2sq", cells=12)
    assert "PartitionFilters: [" in plan_of(V.search_cells(spark, path, queries, 2))


def test_mean_pool(spark):
    df = spark.createDataFrame([(1, [1.0, 3.0]), (1, [3.0, 5.0]), (1, None), (2, [7.0, 0.0]), (3, None)],
                               "k long, embedding array<double>")
    assert {r["k"]: r["embedding"] for r in V.mean_pool(df, "k").collect()} == {1: [2.0, 4.0], 2: [7.0, 0.0]}
    assert "Generate" not in plan_of(V.mean_pool(df, "k"))


def test_no_queries_and_no_items(spark, tmp_path):
    _, _, items, queries = tables(spark, 2, n=10)
    assert V.top_k(items, queries.limit(0), 3).collect() == []
    assert V.top_k(items.limit(0), queries, 3).collect() == []
    path = V.build_cells(items.limit(0), str(tmp_path / "c"))
    assert V.search_cells(spark, path, queries, 3).collect() == []
