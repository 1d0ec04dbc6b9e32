"""Toxicity by a classifier chain.

The categories are predicted one after another by sparse linear (logistic, L1) models over
hashed words and word beginnings; a later model also sees the probabilities of the earlier
categories. While training, these probabilities are out of fold: each row's come from models
that have not seen the row. Thresholds are set on the out-of-fold probabilities too (best F1;
the middle of the gap).

Training takes a bounded sample of labelled rows (``train_rows``, least hash of doc_id): one
Spark group per fold and for the final model, in parallel. Scoring covers every whole text.
A word counts once per document, so a document's scores are sums over its distinct words.

Defined cases: null or empty text has no words and gets the base rate's probability; rows
without label, with a null label or without a document take no part in training; a category
with one class only has that class' rate as its probability and rejects nothing; if there are
no labels at all nothing is rejected; repeated documents are scored each; existing columns of
the output's names are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glint.llm.common import releasing, releasing_group, schema_with, stored

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5)                 # lengths of the word beginnings that are features
KNOWN_WORDS = 150_000             # words that a worker keeps hashed


class WordFeatures(dict):
    """Word -> its feature numbers (the word, and its beginnings)."""

    def __init__(self, bits: int):
        super().__init__()
        self.mask = (1 << bits) - 1

    def __missing__(self, word: str) -> tuple[int, ...]:
        import xxhash

        keys = [f"w{word}"] + [f"{k}{word[:k]}" if len(word) >= k else "short" for k in PREFIXES]
        if len(self) > KNOWN_WORDS:
            self.clear()
        self[word] = out = tuple(xxhash.xxh3_64_intdigest(k) & self.mask for k in keys)
        return out


@dataclass
class Link:
    """One model of the chain."""

    category: str
    weights: np.ndarray           # hashed features
    earlier: np.ndarray           # probabilities of earlier categories
    bias: float
    threshold: float


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(rows: np.ndarray, cols: np.ndarray, n: int, extra: np.ndarray, y: np.ndarray, bits: int,
                 l1: float = 2e-4, steps: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """L1 logistic regression by accelerated proximal gradient. (rows, cols): the ones of a sparse matrix
    (repeated ones add up); extra: dense columns; the bias and the dense weights are not penalised."""
    seen, col = np.unique(cols, return_inverse=True)
    df = np.bincount(col, minlength=len(seen))
    keep = df >= 5                                    # too rare to tell anything
    place = np.cumsum(keep) - 1
    ok = keep[col]
    rows, col, seen = rows[ok], place[col[ok]].astype(np.int32), seen[keep]
    del ok, place
    m, k = len(seen), extra.shape[1]
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(col, minlength=m)) / n * 4)      # diagonal preconditioner
    scale = np.minimum(scale, 4.0)
    rate = y.mean()
    w = np.zeros(m + k + 1)
    w[-1] = np.log(rate / (1 - rate))
    v, t, step = w.copy(), 1.0, 1.0

    def margin(w):
        return np.bincount(rows, weights=(w[:m] * scale)[col], minlength=n) + extra @ w[m:-1] + w[-1]

    def loss(z):
        return np.mean(np.logaddexp(0, z) - y * z)

    for _ in range(steps):
        z = margin(v)
        g = (sigmoid(z) - y) / n
        grad = np.concatenate([np.bincount(col, weights=g[rows], minlength=m) * scale, extra.T @ g, [g.sum()]])
        base = loss(z)
        while True:
            new = v - step * grad
            new[:m] = np.sign(new[:m]) * np.maximum(np.abs(new[:m]) - step * l1, 0)
            d = new - v
            if loss(margin(new)) <= base + grad @ d + d @ d / (2 * step) + 1e-12 or step < 1e-6:
                break
            step /= 2
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t2 * (new - w)
        done = np.abs(new - w).max() < 1e-5
        w, t = new, t2
        step *= 1.2
        if done:
            break
    full = np.zeros(1 << bits, dtype=np.float32)
    full[seen] = w[:m] * scale
    return full, w[m:-1], float(w[-1])


def training_rows(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], folds: int, bits: int,
                  train_rows: int) -> DataFrame:
    """doc_id, fold, one integer per category, features (u32 values) of the sampled labelled documents."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                          *[F.col(c).cast("int").alias(c) for c in categories])
    for c in ("doc_id", *categories):
        known = known.filter(F.col(c).isNotNull())
    known = known.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = text.join(F.broadcast(known), "doc_id")            # at most train_rows rows of integers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feats = WordFeatures(bits)
        for batch in batches:
            out = []
            for t in batch.column("text").to_pylist():
                words = set(WORD.findall(t.lower())) if t else ()
                out.append(np.array([x for w in words for x in feats[w]], dtype="<u4").tobytes())
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(out, pa.binary())],
                                             [*kept, "x"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()),
                           *[T.StructField(c, T.IntegerType()) for c in categories],
                           T.StructField("x", T.BinaryType())])
    rows = rows.select("doc_id", "text", *categories).mapInArrow(releasing(run), schema)
    rows = rows.dropDuplicates(["doc_id"])
    return rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(folds)).cast("int"))


def fitter(at: int, bits: int):
    """The function that fits one group: all rows but those of its fold, with ``at`` earlier probabilities."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        model = int(pdf["model"].iloc[0])
        pdf = pdf.sort_values("doc_id", ignore_index=True)
        held = (pdf["fold"] == model).to_numpy()
        xs = [np.frombuffer(x, dtype="<i4") for x in pdf["x"]]
        sizes = np.array([len(x) for x in xs])
        rws = np.repeat(np.arange(len(xs), dtype=np.int32), sizes)
        cols = np.concatenate([*xs, np.zeros(0, np.int32)])
        pdf = pdf.drop(columns="x")
        extra = np.array([list(p) for p in pdf["p"]], dtype=float).reshape(len(xs), at)
        y = (pdf["y"] > 0).to_numpy(dtype=float)
        use = ~held
        if use.any() and 0 < y[use].mean() < 1:
            new = (np.cumsum(use) - 1).astype(np.int32)
            on = use[rws]
            w, e, b = fit_logistic(new[rws[on]], cols[on], int(use.sum()), extra[use], y[use], bits)
        else:
            rate = np.clip(y[use].mean() if use.any() else 0.0, 1e-6, 1 - 1e-6)
            w, e, b = np.zeros(1 << bits, np.float32), np.zeros(at), float(np.log(rate / (1 - rate)))
        p = sigmoid(np.bincount(rws, weights=w[cols], minlength=len(xs)) + extra @ e + b)
        out = pd.DataFrame({"doc_id": pdf["doc_id"], "prob": p, "y": y})[held].assign(model=model, weights=None)
        if not held.any():       # the model over all rows: its weights
            hot = np.flatnonzero(w)
            raw = hot.astype("<i8").tobytes() + w[hot].astype("<f8").tobytes() + np.append(e, b).tobytes()
            out = pd.DataFrame({"doc_id": [len(hot)], "prob": [0.0], "y": [0.0], "model": [model], "weights": [raw]})
        return out[["doc_id", "prob", "y", "model", "weights"]]

    return fit


def train_chain(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = ("quality", "toxic"),
                folds: int = 3, bits: int = 18, train_rows: int = 3000) -> list[Link]:
    """The models of all categories, in their order."""
    spark = docs.sparkSession
    rows = stored(training_rows(docs, labels, categories, folds, bits, train_rows), "toxicity-train")
    earlier = rows.select("doc_id", F.array().cast("array<double>").alias("p"))
    chain: list[Link] = []
    for at, c in enumerate(categories):
        models = rows.join(earlier, "doc_id").select("doc_id", "fold", F.col(c).alias("y"), "x", "p")
        models = models.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(folds))))     # folds: all rows

        done = stored(models.groupBy("model").applyInPandas(
            releasing_group(fitter(at, bits)), "doc_id long, prob double, y double, model int, weights binary"), "toxicity-fit")
        oof = done.filter("weights is null")
        final = done.filter("weights is not null").collect()
        scored = oof.select("prob", "y").toPandas()             # at most train_rows rows
        w, e, b = np.zeros(1 << bits, np.float32), np.zeros(at), -30.0
        for r in final:
            raw, hot = bytes(r["weights"]), r["doc_id"]
            w[np.frombuffer(raw, "<i8", hot)] = np.frombuffer(raw, "<f8", hot, 8 * hot)
            tail = np.frombuffer(raw, "<f8", at + 1, 16 * hot)
            e, b = tail[:-1].copy(), float(tail[-1])
        chain.append(Link(c, w, e, b, best_threshold(scored["prob"].to_numpy(), scored["y"].to_numpy())))
        earlier = (earlier.join(oof.select("doc_id", "prob"), "doc_id", "left")
                   .select("doc_id", F.concat("p", F.array(F.coalesce("prob", F.lit(0.0)))).alias("p")))
    return chain


def best_threshold(prob: np.ndarray, y: np.ndarray) -> float:
    """The probability above which F1 is best, in the middle of the gap between two rows; 1.1 (reject
    nothing) without rows of both classes."""
    if not 0 < y.sum() < len(y):
        return 1.1
    order = np.argsort(-prob, kind="stable")
    p, hit = prob[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(p) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = -1           # not between equal values
    at = int(np.argmax(f1))
    return float((p[at] + p[at + 1]) / 2) if at + 1 < len(p) else float(p[at])


def score_chain(docs: DataFrame, chain: list[Link], text: str = "text") -> DataFrame:
    """``docs`` with ``p_<category>`` of every category of the chain."""
    bits = int(len(chain[0].weights)).bit_length() - 1
    names = [f"p_{c.category}" for c in chain]
    spark = docs.sparkSession
    # features x categories weights: a size fixed by ``bits``
    held = spark.sparkContext.broadcast((np.stack([c.weights for c in chain], axis=1),
                                         [(c.earlier, c.bias) for c in chain]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, rest = held.value
        feats = WordFeatures(bits)
        hot = weights.any(axis=1)

        class Weight(dict):
            """Word -> its weights, None without any."""

            def __missing__(self, word):
                if len(self) > KNOWN_WORDS:
                    self.clear()
                ids = list(feats[word])
                out = self[word] = tuple(weights[ids].sum(axis=0).tolist()) if hot[ids].any() else None
                del feats[word]
                return out

        weight = Weight()
        for batch in batches:
            sums = np.zeros((batch.num_rows, len(rest)))
            for i, t in enumerate(batch.column(text)):
                t = t.as_py()
                if t:
                    found = [x for x in map(weight.__getitem__, set(WORD.findall(t.lower()))) if x is not None]
                    if found:
                        sums[i] = np.sum(found, axis=0)
            probs = []
            for at, (earlier, bias) in enumerate(rest):
                z = sums[:, at] + bias
                for p, e in zip(probs, earlier, strict=True):
                    z = z + e * p
                probs.append(sigmoid(z))
            kept = [c for c in batch.schema.names if c.lower() not in names]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(p) for p in probs],
                                             [*kept, *names])

    return docs.mapInArrow(releasing(run), schema_with(docs, **{n: T.DoubleType() for n in names}))


def classify(docs: DataFrame, labels: DataFrame, category: str = "toxic", **how) -> DataFrame:
    """``docs`` with the chain's probabilities and the decision ``category`` (boolean)."""
    chain = train_chain(docs, labels, **how)
    link = next(c for c in chain if c.category == category)
    return score_chain(docs, chain).withColumn(category, F.col(f"p_{category}") >= F.lit(link.threshold))
