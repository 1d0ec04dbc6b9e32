"""Near-duplicate documents: banded MinHash, sequential Bayesian verification, exact check.

1. Texts become sets of hashed word shingles and signatures. Equal sets are one class; the
   class member with the smallest id stands for it, so exact copies cost one row each.
2. Bands of the signature propose candidates: each class against the smallest id that shares
   a bucket with it (one pair per class, never all pairs of a bucket).
3. A candidate's signatures are compared batch by batch. With m of n equal values the
   posterior of the similarity under a uniform prior is Beta(m + 1, n - m + 1); the pair is
   dropped as soon as the chance that it reaches the threshold is below ``miss``.
4. Survivors are verified on their full sets, and components are formed.
5. Buckets whose members are in several components may hide links that have not been tested.
   There the members of different components are compared with each other, block
   against block within tasks, by the same pruning; survivors are verified and joined in.
   Links inside a component change nothing, so the result has every link of the candidates.

Defined cases: texts without words have no shingles and are linked with nothing; rows
without an id are linked with nothing, have no component and are kept; rows that repeat an
id are one vertex; extra columns pass through in ``keep_one``; an empty table gives an empty
table.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glint.llm.common import releasing, slices, stored
from glint.llm.components import components
from glint.llm.words import SPACE, hashed_words, mix, shingles, text_bytes

SLICE_BYTES = 2 << 20
BLOCK = 500                # members of a bucket that are compared with as many others at a time


@functools.lru_cache(maxsize=8)
def least_matches(t_num: int, t_den: int, hashes: int, batch: int, miss: float) -> tuple[int, ...]:
    """For n = batch, 2 batch, ...: the least m with P(similarity >= t | m of n equal) >= miss."""
    t, out = t_num / t_den, []
    for n in range(batch, hashes + 1, batch):
        m = 0
        # P(Beta(m+1, n-m+1) >= t) = P(Binomial(n+1, t) <= m)
        tail = (1 - t) ** (n + 1)
        while tail < miss and m < n:
            m += 1
            tail += math.comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def features(docs: DataFrame, words: int, hashes: int) -> DataFrame:
    """doc_id, n_shingles, class_key, signature (little-endian u32 values) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        k = np.arange(1, 2 * hashes + 1, dtype=np.uint64)
        mul, add = np.split(mix(k * np.uint64(0x9E3779B97F4A7C15)), 2)
        mul |= np.uint64(1)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                raw, sizes = text_bytes(part.column("text"))
                sets = shingles(*hashed_words(raw, sizes, SPACE), words)
                sigs, keys = [], []
                for s in sets:
                    low = np.full(hashes, np.uint64(0xFFFFFFFFFFFFFFFF))
                    for at in range(0, len(s), 2048):
                        np.minimum(low, (s[at:at + 2048, None] * mul + add).min(axis=0), out=low)
                    sigs.append((low >> np.uint64(32)).astype("<u4").tobytes())
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                    ["doc_id", "n_shingles", "class_key", "sig"])

    return docs.select("doc_id", "text").mapInArrow(
        releasing(run), "doc_id long, n_shingles long, class_key binary, sig binary")


def _band_rows(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(bucket, band, id, component) of each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype="<u4").reshape(n, -1)
            for b in range(bands):
                h = np.full(n, np.uint64(b + 1))
                for c in range(b * rows, (b + 1) * rows):
                    h = mix(h + sig[:, c].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(np.full(n, b, np.int32)), batch.column("id"),
                     batch.column("component")], ["bucket", "band", "id", "component"])

    return classes.select("id", "component", "sig").mapInArrow(releasing(run), "bucket long, band int, id long, component long")


def _prune(pairs: DataFrame, classes: DataFrame, num: int, den: int, hashes: int, batch: int,
           miss: float) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures leave a chance of similarity >= num / den."""
    c = classes.select("id", "n_shingles", "sig")
    both = (pairs.join(c.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb")), "b")
            .join(c.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sa")), "a")
            .filter(den * F.least("na", "nb") >= num * F.greatest("na", "nb")))
    least = least_matches(num, den, hashes, batch, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            n = rb.num_rows
            if not n:
                continue
            x, y = (np.frombuffer(b"".join(rb.column(s).to_pylist()), dtype="<u4").reshape(n, -1) for s in ("sa", "sb"))
            left, equal = np.arange(n), np.zeros(n, dtype=np.int64)
            for i, m in enumerate(least):
                cols = slice(i * batch, (i + 1) * batch)
                equal[left] += (x[left, cols] == y[left, cols]).sum(axis=1)
                left = left[equal[left] >= m]
            yield pa.RecordBatch.from_arrays([rb.column("a").take(pa.array(left)), rb.column("b").take(pa.array(left))],
                                             ["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(releasing(run), "a long, b long")


def _sets(ids: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """id and full shingle set (sorted u64 values) of the documents in ``ids``."""
    one = docs.select("doc_id", "text").join(ids.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                raw, sizes = text_bytes(part.column("text"))
                out = [s.tobytes() for s in shingles(*hashed_words(raw, sizes, SPACE), words)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.binary())], ["id", "s"])

    return one.mapInArrow(releasing(sets), "id long, s binary")


def _alike(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return den * both >= num * (len(x) + len(y) - both)


def _verify(pairs: DataFrame, full: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose full shingle sets have den * intersection >= num * union."""
    both = (pairs.join(full.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
            .join(full.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a"))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [_alike(*(np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in x), num, den)
                  for x in zip(batch.column("sa"), batch.column("sb"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(releasing(exact), "a long, b long")


def _across(classes: DataFrame, comp: DataFrame, full: DataFrame, bands: int, rows: int, num: int, den: int,
            batch: int, miss: float) -> DataFrame:
    """Links between components: all pairs of different components that share a bucket are tested where the
    bucket's block is, each pair in its first common band; a pair that is connected by now is skipped."""
    labelled = stored(classes.join(comp, "id", "left").select("id", "n_shingles", "sig", F.coalesce(
        "component", "id").alias("component")), "labelled")
    m = _band_rows(labelled, bands, rows)
    mixed = (m.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                     F.count(F.lit(1)).alias("n")).filter("lo < hi").select("bucket", "n"))
    m = m.join(mixed, "bucket")
    blocks = F.ceil(F.col("n") / BLOCK)
    m = m.withColumn("k", F.pmod(F.xxhash64("id"), blocks)).withColumn("j", F.explode(F.sequence(F.lit(0), blocks - 1)))
    m = (m.select("bucket", "band", "id", "component", "k", F.least("k", "j").alias("p"), F.greatest("k", "j").alias("q"))
         .join(labelled.select("id", "n_shingles", "sig"), "id").join(full, "id"))
    hashes = bands * rows
    least = least_matches(num, den, hashes, batch, miss)

    def cross(t: pa.Table) -> pa.Table:
        n = t.num_rows
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype="<u4").reshape(n, -1)
        ids, comps, k, size = (t.column(c).to_numpy() for c in ("id", "component", "k", "n_shingles"))
        comps = comps.copy()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in t.column("s").to_pylist()]
        band = t.column("band")[0].as_py()
        one_block = t.column("p")[0].as_py() == t.column("q")[0].as_py()
        found = []
        for i in range(n):
            ok = (comps != comps[i]) & (ids > ids[i]) & (den * np.minimum(size, size[i]) >= num * np.maximum(size, size[i]))
            if not one_block:
                ok &= k != k[i]
            left = np.flatnonzero(ok)
            equal = np.zeros(len(left), dtype=np.int64)
            for b, low in enumerate(least):
                cols = slice(b * batch, (b + 1) * batch)
                equal += (sig[left, cols] == sig[i, cols]).sum(axis=1)
                left, equal = left[equal >= low], equal[equal >= low]
                if not len(left):
                    break
            if band and len(left):
                same = (sig[left, :band * rows] == sig[i, :band * rows]).reshape(len(left), band, rows)
                keep = ~same.all(axis=2).any(axis=1)
                left, equal = left[keep], equal[keep]
            for j in left[np.argsort(-equal, kind="stable")].tolist():       # the likeliest first
                if comps[j] != comps[i] and _alike(sets[i], sets[j], num, den):
                    found.append((ids[i], ids[j]))
                    comps[comps == comps[j]] = comps[i]
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return m.groupBy("bucket", "p", "q").applyInArrow(cross, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (75, 100), bands: int = 32,
                    rows: int = 4, batch: int = 32, miss: float = 1e-6) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest reachable doc_id), kept, of every row of ``docs``.

    With 32 bands of 4 a pair at 0.75 escapes the bands with a chance of 6e-6, and the pruning
    with ``miss``; every other decision is exact.
    """
    num, den = threshold
    hashes = bands * rows
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    feats = stored(features(docs, words, hashes), "minhash")
    classes = stored(
        feats.filter("n_shingles > 0 and doc_id is not null").groupBy("class_key")
        .agg(F.min("doc_id").alias("id"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("sig").alias("sig")),
        "classes")
    bands_t = _band_rows(classes.withColumn("component", F.col("id")), bands, rows)
    least = bands_t.groupBy("bucket").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n"))
    # each class against the smallest id of all of its buckets; n: the members of its largest bucket
    near = stored(bands_t.join(least, "bucket").groupBy("id").agg(
        F.min(F.when(F.col("a") < F.col("id"), F.col("a"))).alias("a"), F.max("n").alias("n")), "candidates")
    full = stored(_sets(near.filter("n > 1").select(F.col("id").alias("doc_id")), docs, words), "shingle-sets")
    pairs = near.filter("a is not null").select("a", F.col("id").alias("b"))
    pairs = _prune(pairs, classes, num, den, hashes, batch, miss)
    links = stored(_verify(pairs, full, num, den), "links")
    comp = stored(components(links), "components")
    more = stored(_across(classes, comp, full, bands, rows, num, den, batch, miss), "links")
    if not more.isEmpty():
        comp = stored(components(links.union(more)), "components")
    of_class = (classes.join(comp, "id", "left")
                .select("class_key", F.coalesce("component", "id").alias("component_id")))
    out = feats.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0),
                                                      F.col("class_key")).alias("class_key"))
    out = out.join(of_class, "class_key", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id",
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """``docs`` without the near duplicates of a document with a smaller id."""
    gone = near_duplicates(docs, **how).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
