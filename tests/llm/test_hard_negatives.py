"""Hard negatives against scores of all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glint.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, rank string, score string"


def brute(rows, positives=5, negatives=10):
    rows = [(i, [x for x in v], lab) for i, v, lab in rows if i is not None and v is not None and lab is not None
            and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: int(sum(x * y for x, y in zip(a, b, strict=False)))
    out = []
    heads = {}
    for i, v, lab in rows:
        if i % 10 == 0:
            heads[i] = min(heads.get(i, (lab, v)), (lab, v))
    for a, (lab, v) in heads.items():
        scored = sorted((-dot(v, w), i, lb) for i, w, lb in rows if i != a)
        for s, i, _ in [x for x in scored if x[2] == lab][:positives]:
            fits = [x for x in scored if x[2] != lab and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(a, i, n + 1, x[1], -s, -x[0]) for n, x in enumerate(fits)]
    return sorted(out)


def rows_of(seed, n=240):
    rng = random.Random(seed)
    middle = [[rng.randint(-40, 40) for _ in range(6)] for _ in range(4)]
    rows = []
    for i in range(n):
        c = rng.choice(middle)
        rows.append((i, [float(x + rng.randint(-12, 12)) for x in c], rng.randint(0, 3)))
    hot = [float(x) for x in middle[0]]
    rows += [(n + i, hot, 1 + i % 5 // 4) for i in range(n // 2)]       # a third of all rows: one vector
    rows += [(None, hot, 1), (2000, None, 1), (2010, hot, None), (2020, [1.0, None], 1), (2030, [math.nan, 1.0], 2),
             (2040, [math.inf], 2), (2050, [], 0), (2060, [3.0, 9.0], 1), (2070, [0.0] * 6, 9), (11, hot, 2),
             (rows[30][0], hot, 0), rows[41], rows[50]]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "r", "s") for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("small", [False, True])
def test_equal_to_all_pairs(spark, monkeypatch, small):
    if small:                       # many trees, blocks of anchors, slices of candidates
        for name, v in (("TREE", 4), ("ROWS", 3), ("BLOCK_BYTES", 500), ("SEEDS", 3)):
            monkeypatch.setattr(hn, name, v)
    rows = rows_of(3, 60 if small else 240)
    got = [tuple(r) for r in hn.mine(frame(spark, rows), F.col("vec_id") % 10 == 0).collect()]
    assert sorted(got) == brute(rows)
    assert len(got) > 50


def test_none(spark):
    df = frame(spark, rows_of(1, 60))
    assert hn.mine(df.limit(0), F.col("vec_id") % 10 == 0).collect() == []
    assert hn.mine(df, F.lit(False)).collect() == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(4)
    middle = rng.integers(-200, 200, (5, 16))
    v = (middle[rng.integers(0, 5, 60)] + rng.integers(-3, 4, (60, 16))).astype(float)
    x = (middle[rng.integers(0, 5, 500)] + rng.integers(-3, 4, (500, 16))).astype(float)
    tree = hn.spanning_tree(v)
    assert sorted(i for i, _, _ in tree) == list(range(60))
    for i, p, edge in tree[1:]:
        assert edge >= np.linalg.norm(v[i] - v[p])
    exact = v @ x.T
    norm = np.sqrt((x * x).sum(axis=1)) * (1 + 1e-9) + 1e-9
    window = (np.quantile(exact, 0.9), np.inf)
    scored = 0
    for a, place, scores in hn.walk(tree, v, x, norm, lambda _: window):
        assert np.array_equal(scores, exact[a][place])
        assert set(np.flatnonzero(exact[a] >= window[0])) <= set(place.tolist())
        scored += len(place)
    assert scored < 0.5 * exact.size


def test_tree_of_least_length():
    rng = np.random.default_rng(2)
    v = rng.integers(0, 50, (30, 3)).astype(float)
    edges = sorted((np.linalg.norm(v[i] - v[j]), i, j) for i in range(30) for j in range(i))
    group, total = list(range(30)), 0.0
    for d, i, j in edges:           # by joining the nearest groups
        if group[i] != group[j]:
            total += d
            group = [group[i] if g == group[j] else g for g in group]
    assert sum(e for _, _, e in hn.spanning_tree(v)) == pytest.approx(total, rel=1e-6)
