"""Language-model scoring by deleted interpolation.

An n-gram model mixes the maximum-likelihood estimates of its orders,

    P_k(w | context) = m_k(b) * c(context, w) / c(context) + (1 - m_k(b)) * P_{k-1}(w | shorter context)

from P_0 = 1 / (V + 1) up to the highest order; b is the bucket of the context's frequency (its
power of two), m_k(b) the mixture weight of order k there (0 where the context is unseen). The
weights come from expectation-maximisation over the deleted part of the training documents,
with the counts of the rest; the scores use the counts of all training documents.

Counts cover the whole corpus. Documents are dealt to blocks by a hash; a block sends each of
its distinct n-grams once, as sorted 64-bit hashes, to the bucket of the hash, where the counts of
all blocks meet and go back in the block's order. So a frequent n-gram costs a bucket one entry for
each block, and a block's words are found again by their place. The counts of every token are
written once, in the shared folder; the weights and the scores are read from there.

Defined cases: a null text is an empty text (one token, the end); a null id is carried as
null; repeated rows are scored each and counted each; ties do not occur; a text is never cut (very
long ones make a block larger); an empty table gives an empty result; without training documents
P is 1 / (V + 1) = 1 and all scores are 0; columns other than the id and the text are not read, so
their names cannot clash. Two n-grams whose 62-bit hashes agree count as one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glint.llm.common import shared_path, slices, total_bytes
from glint.llm.words import BASE, SPACE, hashed_words, mix, text_bytes

BLOCK_BYTES = 16 << 20     # text of a block
BUCKET_BYTES = 8 << 20     # text whose n-grams make up a bucket
LEAST_PARTS = 64           # blocks and buckets of a small corpus
SLICE_BYTES = 2 << 20      # text that is split into words at a time
CHUNK_TOKENS = 1 << 16     # tokens of a written row; a document is never cut
MOST_ORDER = 4             # the two low bits of an n-gram's hash hold its order
TEST, KEPT, DELETED = 0, 1, 2

_M = np.uint64
BEGIN, END = _M(0x0B5297A4D3C1E867), _M(0x61C8864680B583EB)

GRAM_ROWS = "bucket long, block long, first long, hashes binary, kept binary, deleted binary"
COUNT_ROWS = "block long, bucket long, kept binary, deleted binary, own long"
TOKEN_ROWS = ("part int, ids array<long>, sizes array<int>, held array<boolean>, counts array<binary>, "
              "deleted array<binary>, train_tokens long, own long")
SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
          "base_score double, score double")


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers as byte planes: one byte for the width, all lowest bytes, all next ones."""
    v = np.ascontiguousarray(values, dtype="<u8")
    width = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
    return bytes([width]) + v.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(raw: bytes) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(raw, dtype=np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def token_hashes(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all rows (the words of ``text``, then the end), and tokens per row."""
    words, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for batch in table.select(["text"]).to_batches():
        for part in slices(batch, "text", SLICE_BYTES):
            h, n = hashed_words(*text_bytes(part.column("text")), SPACE)
            out = np.full(len(h) + len(n), END)
            last = np.zeros(len(out), dtype=bool)
            last[np.cumsum(n + 1) - 1] = True
            out[~last] = h
            words.append(out)
            sizes.append(n + 1)
    return np.concatenate(words), np.concatenate(sizes)


def gram_hashes(tokens: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """Of every token the hashes of the 1-gram .. ``order``-gram that end there; a begin mark fills up."""
    out, h, back = [], mix(tokens), tokens
    starts = (np.cumsum(sizes) - sizes)
    for k in range(order):
        if k:
            back = np.append(BEGIN, back[:-1])
            back[starts] = BEGIN
            h = mix(h * _M(BASE) + back)
        out.append((h & ~_M(3)) | _M(k))
    return out


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorting order of ``h``, where each distinct value begins in it, and the distinct values."""
    order = np.argsort(h)
    s = h[order]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    return order, first, s[first]


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first) if len(first) else np.zeros(0, values.dtype)


def _bounds(distinct: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket (a range of hashes) begins in the sorted values, and the end."""
    of = ((distinct >> _M(32)) * _M(buckets)) >> _M(32)
    return np.searchsorted(of, np.arange(buckets + 1, dtype=np.uint64))


def _grams(order: int, buckets: int):
    """Arrow function: the distinct n-grams of a block with their counts, by bucket."""
    def run(table: pa.Table) -> pa.Table:
        tokens, sizes = token_hashes(table)
        role = np.repeat(table.column("role").to_numpy().astype(np.int64), sizes)
        at, first, distinct = _distinct(np.concatenate(gram_hashes(tokens, sizes, order)))
        role = np.tile(role, order)[at]
        kept, deleted = _sums((role == KEPT) * 1, first), _sums((role == DELETED) * 1, first)
        cut = _bounds(distinct, buckets)
        block = table.column("block")[0].as_py()
        rows = []
        for b, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
            if i < j:
                d = distinct[i:j]
                rows.append((b, block, int(d[:1].view(np.int64)[0]), pack(np.diff(d)), pack(kept[i:j]),
                             pack(deleted[i:j])))
        return _table(rows, ["bucket", "block", "first", "hashes", "kept", "deleted"],
                      [pa.int64()] * 3 + [pa.binary()] * 3)
    return run


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _total(table: pa.Table) -> pa.Table:
    """Arrow function: the corpus's counts of a bucket's n-grams, for each block in its own order.

    ``own`` is the number of distinct training words of the bucket that the block has as the first.
    """
    blocks = table.column("block").to_numpy()
    hashes = []
    for first, raw in zip(table.column("first").to_pylist(), table.column("hashes").to_pylist(), strict=True):
        h = np.append(np.array([first], dtype=np.int64).view(np.uint64), unpack(raw))
        hashes.append(np.cumsum(h, dtype=np.uint64))
    sizes = np.array([len(h) for h in hashes])
    at, first, distinct = _distinct(np.concatenate(hashes))
    group = np.zeros(len(at), dtype=np.int64)
    group[at] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(at))))
    total = []
    for name in ("kept", "deleted"):
        count = np.concatenate([unpack(x) for x in table.column(name).to_pylist()]).astype(np.int64)
        total.append((count, _sums(count[at], first)))
    trained = total[0][0] + total[1][0] > 0
    word = np.flatnonzero((distinct & _M(3)) == 0)
    owner = np.where(trained, np.repeat(blocks, sizes), np.iinfo(np.int64).max)[at]
    owner = np.minimum.reduceat(owner, first)[word]
    ends = np.cumsum(sizes)
    rows = []
    bucket = table.column("bucket")[0].as_py()
    for b, i, j in zip(blocks.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
        g = group[i:j]
        rows.append((b, bucket, pack(total[0][1][g]), pack(total[1][1][g]), int((owner == b).sum())))
    return _table(rows, ["block", "bucket", "kept", "deleted", "own"],
                  [pa.int64()] * 2 + [pa.binary()] * 2 + [pa.int64()])


def _counted(order: int):
    """Arrow function: a block's documents with the corpus's counts of each token's n-grams, in rows
    of about ``CHUNK_TOKENS`` tokens; documents of the deleted part apart from the others."""
    schema = [("part", pa.int32()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())),
              ("held", pa.list_(pa.bool_())), ("counts", pa.list_(pa.binary())), ("deleted", pa.list_(pa.binary())),
              ("train_tokens", pa.int64()), ("own", pa.int64())]

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        names, types = zip(*schema, strict=True)
        if not len(table):
            return _table([], names, types)
        tokens, sizes = token_hashes(table)
        found = found.sort_by("bucket")
        grams = np.concatenate(gram_hashes(tokens, sizes, order))
        at, first, _ = _distinct(grams)
        place = np.zeros(len(grams), dtype=np.int64)
        place[at] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(at))))
        place = place.reshape(order, -1)
        kept, deleted = (np.concatenate([unpack(x) for x in found.column(c).to_pylist()]) for c in ("kept", "deleted"))
        ids, roles = table.column("doc_id").to_pylist(), table.column("role").to_numpy()
        ends = np.cumsum(sizes)
        own, rows = sum(found.column("own").to_pylist()), []
        for part in (0, 1):
            mine = np.flatnonzero((roles == DELETED) == bool(part))
            chunk = (np.cumsum(sizes[mine]) - sizes[mine]) // CHUNK_TOKENS
            for docs in np.split(mine, np.flatnonzero(np.diff(chunk)) + 1) if len(mine) else []:
                where = np.concatenate([np.arange(ends[d] - sizes[d], ends[d]) for d in docs.tolist()])
                all_of = [pack((kept + deleted)[p[where]]) for p in place]
                gone = [pack(deleted[p[where]]) for p in place] if part else []
                rows.append((part, [ids[d] for d in docs.tolist()], sizes[docs], roles[docs] == TEST, all_of, gone,
                             int(sizes[docs][roles[docs] != TEST].sum()), own))
                own = 0
        return _table(rows, names, types)
    return run


def _levels(counts: list[np.ndarray], sizes: np.ndarray, ends_in: float, tokens: float) -> list[tuple]:
    """Of each order the estimate c / c(context) of every token, and its context's bucket (0: unseen)."""
    starts = np.cumsum(sizes) - sizes
    out = []
    for k, c in enumerate(counts):
        if k:
            context = np.append(0, counts[k - 1][:-1])
            context[starts] = ends_in                  # as many begins as ends
        else:
            context = np.full(len(c), tokens)
        seen = context > 0
        f = np.divide(c, context, out=np.zeros(len(c)), where=seen)
        out.append((f, np.frexp(context)[1] * seen))   # 1 + floor(log2) of a seen context
    return out


def _mixed(levels: list[tuple], weights: np.ndarray, words: int) -> list[np.ndarray]:
    """P_0 .. P_order of every token."""
    p = [np.full(len(levels[0][0]), 1.0 / (words + 1))]
    for k, (f, b) in enumerate(levels):
        m = weights[k][b]
        p.append(m * f + (1 - m) * p[-1])
    return p


def _lists(batch: pa.RecordBatch):
    """Rows of the written table: counts of all training documents, of the deleted ones, sizes, ids, held."""
    for row in batch.to_pylist():
        yield ([unpack(x).astype(np.float64) for x in row["counts"]],
               [unpack(x).astype(np.float64) for x in row["deleted"] or []],
               np.array(row["sizes"], dtype=np.int64), row["ids"], row["held"])


BUCKETS = 65               # context frequencies by powers of two, and 0


def learn_weights(counted: DataFrame, order: int, words: int, tokens: int, ends: int, gone: tuple[int, int],
                  rounds: int = 20, stop: float = 1e-4) -> np.ndarray:
    """Mixture weights by expectation-maximisation over the deleted part's tokens.

    Every round is one pass over the deleted part; only sums by (order, bucket) reach the driver. It ends
    when the mean log-likelihood of a token grows by less than ``stop``. ``gone``: tokens and documents of
    the deleted part.
    """
    weights = np.full((order, BUCKETS), 0.5)
    weights[:, 0] = 0.0                                # an unseen context has no estimate
    part = counted.filter(F.col("part") == 1).select("ids", "sizes", "held", "counts", "deleted")
    before = -np.inf
    for _ in range(rounds):
        now = weights.copy()

        def expect(batches):
            took, met, like, n = np.zeros((order, BUCKETS)), np.zeros((order, BUCKETS)), 0.0, 0
            for batch in batches:
                for all_of, deleted, sizes, _, _ in _lists(batch):
                    kept = [a - d for a, d in zip(all_of, deleted, strict=True)]
                    levels = _levels(kept, sizes, ends - gone[1], tokens - gone[0])
                    p = _mixed(levels, now, words)
                    like, n = like + float(np.log(p[-1]).sum()), n + len(p[-1])
                    left = np.ones(len(p[-1]))
                    for k in range(order - 1, -1, -1):
                        f, b = levels[k]
                        here = left * (now[k][b] * f / p[k + 1])
                        took[k] += np.bincount(b, here, BUCKETS)
                        met[k] += np.bincount(b, left, BUCKETS)
                        left = left - here
            rows = [(k, b, took[k, b], met[k, b]) for k in range(order) for b in range(BUCKETS) if met[k, b]]
            rows.append((-1, 0, like, float(n)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.float64(),
                                                                          pa.float64()), strict=True)],
                names=["k", "b", "took", "met"])

        sums = part.mapInArrow(expect, "k int, b int, took double, met double").groupBy("k", "b").agg(
            F.sum("took").alias("took"), F.sum("met").alias("met")).collect()
        like = 0.0
        for r in sums:
            if r["k"] < 0:
                like = r["took"] / r["met"] if r["met"] else 0.0
            elif r["b"] and r["met"]:
                weights[r["k"], r["b"]] = r["took"] / r["met"]
        if like - before < stop:
            break
        before = like
    return weights


def count_tokens(docs: DataFrame, role: Column, order: int) -> DataFrame:
    """The written table of all documents with the corpus's counts of their n-grams (see ``_counted``)."""
    spark = docs.sparkSession
    size = total_bytes(docs, "text")
    blocks = max(LEAST_PARTS, -(-size // BLOCK_BYTES))
    buckets = max(LEAST_PARTS, -(-size * order // (2 * BUCKET_BYTES)))
    d = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"),
                    F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), role.cast("int").alias("role"))
    found = (d.groupBy("block").applyInArrow(_grams(order, buckets), GRAM_ROWS)
             .groupBy("bucket").applyInArrow(_total, COUNT_ROWS))
    rows = d.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_counted(order), TOKEN_ROWS)
    path = shared_path(spark, "token-counts")
    rows.write.option("compression", "zstd").partitionBy("part").parquet(path)
    return spark.read.schema(TOKEN_ROWS).parquet(path)


def score_documents(docs: DataFrame, role: Column, order: int = 2, rounds: int = 20) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``.

    ``role``: ``KEPT`` and ``DELETED`` documents are the training documents (the weights are learned on the
    deleted ones), ``TEST`` documents are only scored. ``base_score`` is that of an add-0.1 unigram model;
    ``score`` is the interpolated model's log10 probability of the text.
    """
    if not 1 <= order <= MOST_ORDER:
        raise ValueError(f"order must be 1 to {MOST_ORDER}")
    counted = count_tokens(docs, role, order)
    count = F.aggregate(F.filter("held", lambda h: ~h), F.lit(0).cast("long"), lambda n, _: n + 1)
    sums = {r["part"]: r for r in counted.groupBy("part").agg(
        F.sum("train_tokens").alias("tokens"), F.sum("own").alias("words"), F.sum(count).alias("docs")).collect()}
    of = lambda name, parts=(0, 1): sum(sums[p][name] for p in parts if p in sums)
    tokens, words, ends = of("tokens"), of("words"), of("docs")
    weights = learn_weights(counted, order, words, tokens, ends, (of("tokens", (1,)), of("docs", (1,))), rounds)

    def score(batches):
        names = [f.split()[0] for f in SCORES.split(", ")]
        for batch in batches:
            for counts, _, sizes, ids, held in _lists(batch):
                starts = np.cumsum(sizes) - sizes
                base = np.log10((counts[0] + 0.1) / (tokens + 0.1 * (words + 1)))
                p = _mixed(_levels(counts, sizes, ends, tokens), weights, words)[-1]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(sizes),
                    pa.array(np.add.reduceat((counts[0] > 0) * 1, starts)),
                    pa.array(np.full(len(sizes), tokens, dtype=np.int64)),
                    pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(np.log10(p), starts))],
                    names=names)

    return counted.select("ids", "sizes", "held", "counts", F.array().cast("array<binary>").alias("deleted")).mapInArrow(
        score, SCORES)
