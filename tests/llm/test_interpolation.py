"""Language-model scores against a plain Python model that counts in dictionaries."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glint.llm import interpolation as lm
from tests.llm.test_llm import ODD, docs


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    return [w for w in lower.split(" ") if w] + ["</s>"]


def brute(rows, order, rounds=20, stop=1e-4):
    """(doc_id, n_tokens, n_known, N, base, score) of rows (doc_id, text, role), weights by plain loops."""
    def grams(toks):
        full = ["<s>"] * (order - 1) + toks
        for i in range(len(toks)):
            yield [tuple(full[i + order - 1 - k:i + order]) for k in range(order)]

    count = {r: Counter() for r in (lm.KEPT, lm.DELETED)}
    ends = Counter()
    for _, t, role in rows:
        ends[role] += 1
        if role != lm.TEST:
            for g in grams(words_of(t)):
                count[role].update(g)
    total = count[lm.KEPT] + count[lm.DELETED]
    size = lambda c: sum(n for g, n in c.items() if len(g) == 1)
    n, v = size(total), sum(len(g) == 1 for g in total)
    m = defaultdict(lambda: 0.5)

    def levels(c, g, starts, tokens):
        out = []
        for k in range(order):
            context = g[k][:-1]
            have = tokens if k == 0 else starts if set(context) == {"<s>"} else c[context]
            out.append((c[g[k]] / have if have else 0.0, have and have.bit_length()))
        return out

    def probabilities(lev):
        p = [1 / (v + 1)]
        for k, (f, b) in enumerate(lev):
            w = m[k, b] if b else 0.0
            p.append(w * f + (1 - w) * p[-1])
        return p

    deleted = [g for _, t, role in rows if role == lm.DELETED for g in grams(words_of(t))]
    kept = count[lm.KEPT]
    before = -math.inf
    for _ in range(rounds):
        took, met, like = Counter(), Counter(), 0.0
        for g in deleted:
            lev = levels(kept, g, ends[lm.KEPT], size(kept))
            p, left = probabilities(lev), 1.0
            like += math.log(p[-1])
            for k in reversed(range(order)):
                f, b = lev[k]
                here = left * ((m[k, b] if b else 0.0) * f / p[k + 1])
                took[k, b] += here
                met[k, b] += left
                left -= here
        like = like / len(deleted) if deleted else 0.0
        for key in met:
            if key[1] and met[key]:
                m[key] = took[key] / met[key]
        if like - before < stop:
            break
        before = like
    out = []
    for i, t, _ in rows:
        gs = list(grams(words_of(t)))
        base = sum(math.log10((total[g[0]] + 0.1) / (n + 0.1 * (v + 1))) for g in gs)
        score = sum(math.log10(probabilities(levels(total, g, ends[1] + ends[2], n))[-1]) for g in gs)
        out.append((i, len(gs), sum(total[g[0]] > 0 for g in gs), n, base, score))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, r[1], r[4])


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(spark, order, monkeypatch):
    monkeypatch.setattr(lm, "SLICE_BYTES", 40)
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 30)
    rng = random.Random(order)
    vocabulary = [rng.choice("ABcdéß漢") * rng.randint(1, 3) + str(i % 7) for i in range(30)]
    texts = [" ".join(rng.choice(vocabulary[:rng.randint(1, 30)]) for _ in range(rng.randint(0, 40)))
             for _ in range(80)] + ["same words again"] * 40
    df = docs(spark, ODD + texts)
    role = F.when(F.col("doc_id").isNull() | (F.col("doc_id") % 5 == 0), lm.TEST).when(
        F.col("doc_id") % 5 == 1, lm.DELETED).otherwise(lm.KEPT)
    want = brute([(r["doc_id"], r["text"], r["role"]) for r in df.withColumn("role", role).collect()], order)
    got = [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"])
           for r in lm.score_documents(df, role, order).collect()]
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:4] == b[:4]
        assert a[4:] == pytest.approx(b[4:], rel=1e-9)


def test_many_blocks_and_one_block_agree(spark, monkeypatch):
    rng = random.Random(8)
    df = docs(spark, [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))) for _ in range(200)])
    role = F.when(F.col("doc_id") % 4 == 0, lm.TEST).when(F.col("doc_id") % 4 == 1, lm.DELETED).otherwise(lm.KEPT)
    many = {r["doc_id"]: r for r in lm.score_documents(df, role).collect()}
    monkeypatch.setattr(lm, "LEAST_PARTS", 1)
    for r in lm.score_documents(df, role).collect():
        assert (r["n_known"], r["train_tokens"]) == (many[r["doc_id"]]["n_known"], many[r["doc_id"]]["train_tokens"])
        assert r["score"] == pytest.approx(many[r["doc_id"]]["score"], rel=1e-9)


def test_no_rows_and_no_training_rows(spark):
    df = docs(spark, ["a b", None])
    assert lm.score_documents(df.limit(0), F.lit(lm.KEPT)).collect() == []
    got = lm.score_documents(df, F.lit(lm.TEST)).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got) == [
        (1, 0, 0.0, 0.0), (3, 0, 0.0, 0.0)]


def test_packed_integers():
    for v in ([], [0], [1, 255], [256, 0, 70000], [2 ** 63, 2 ** 64 - 1, 5]):
        a = np.array(v, dtype=np.uint64)
        assert lm.unpack(lm.pack(a)).tolist() == v


def test_held_out_texts_are_likelier_than_by_the_base(spark):
    from glint.llm.queries import QUERIES

    out = QUERIES["op11_lm_scoring"](spark, "/root/testdata/sf0.01").toPandas()
    assert len(out) == 1000
    held = out[out["held_out"]]
    assert all(out["held_out"] == [zlib.crc32(str(i).encode()) % 10 == 0 for i in out["doc_id"]])
    assert held["score"].sum() > held["base_score"].sum()
