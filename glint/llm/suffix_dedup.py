"""Removal of byte strings that also occur in an earlier document, by a phrase parse.

A trigger is the least rolling hash of a 20-byte window among those inside a string of
``length`` bytes. Consecutive strings with the same trigger make a phrase, so the parse
depends on the text alone: phrases overlap by ``length - 1`` bytes, every string of
``length`` bytes lies in exactly one phrase of its document, and equal strings have equal
triggers wherever they occur. The corpus is handled in blocks of documents:

1. Each block lists its triggers; triggers are grouped by value, and those of a single
   document can hold no repeat. The others go back to their blocks.
2. The blocks' dictionaries (distinct phrases with such triggers, and the smallest document
   of each) are dealt out by trigger. Their suffixes are sorted by the first ``length``
   bytes; neighbours that agree in these bytes are the same string, and its first document
   is the least of their phrases' documents. Equal phrases count once, so highly repetitive
   text costs little.
3. Back in its block, each phrase tells which of its strings begin in an earlier document,
   and the parse puts these marks into corpus order.

The documents are shuffled once; the three passes share that exchange. Nothing is sent that
grows with the number of copies: a block sends a trigger or a phrase once.

Defined cases: null text has no bytes; a null doc_id counts as larger than any other; rows
with the same doc_id do not remove from each other; texts shorter than ``length`` are kept;
extra columns are ignored; an empty table gives an empty table. Phrases of a block are told
apart by 64-bit hashes; strings are compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glint.llm.bpe import spread_out
from glint.llm.common import slices, total_bytes
from glint.llm.words import BASE, BYTE, UNBASE, mix, powers, text_bytes

GRAM = 20                     # bytes of the rolling window
BLOCK_BYTES = 6 << 20         # text of a block
BUCKET_BYTES = 12 << 20       # text whose triggers meet in a task
SLICE_BYTES = 1 << 20         # text that is hashed at a time
CHUNK = 1 << 18               # suffixes that are sorted at a time
LAST = np.iinfo(np.int64).max


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Least of h[i : i + width] for every i."""
    m, have = h, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[:len(m) - rest], m[rest:]) if rest else m


def parse(raw: np.ndarray, sizes: np.ndarray, length: int):
    """Phrases of texts that stand one after another: document, start, strings in it, trigger, hash."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    width = length - GRAM + 1
    n = len(raw)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE[raw] * powers(BASE, n), dtype=np.uint64, out=total[1:])
    back = powers(UNBASE, n)
    least = sliding_min(mix((total[GRAM:] - total[:-GRAM]) * back[:n - GRAM + 1]), width)
    count = np.maximum(0, sizes - length + 1)
    first = np.cumsum(sizes) - sizes
    at = spread_out(first, count)                              # where strings begin
    least = least[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
    run = np.flatnonzero(new)
    strings = np.diff(np.append(run, len(at)))
    pieces = -(-strings // width)                              # a run of equal triggers may be long
    run, whole = np.repeat(run, pieces), np.repeat(strings, pieces)
    part = spread_out(np.zeros(len(pieces), np.int64), pieces)
    run, strings = run + part * width, np.minimum(width, whole - part * width)
    start, key = at[run], least[run]
    doc = np.repeat(np.arange(len(sizes)), count)[run]
    end = start + strings + length - 1
    phrase = mix((total[end] - total[start]) * back[start] + strings.astype(np.uint64))
    return doc, start, strings, key, phrase


def block_slices(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, bytes and sizes of a block's documents, slice by slice."""
    for batch in t.select(["doc_id", "text"]).combine_chunks().to_batches():
        for part in slices(batch, "text", SLICE_BYTES):
            raw, sizes = text_bytes(part.column("text"))
            yield part.column("doc_id").fill_null(LAST).to_numpy(zero_copy_only=False), raw, sizes


def by_phrase(phrase: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct phrases, an occurrence of each in its smallest document, and that document."""
    order = np.lexsort((doc, phrase))
    head = np.ones(len(order), dtype=bool)
    head[1:] = phrase[order[1:]] != phrase[order[:-1]]
    one = order[head]
    return phrase[one], one, doc[one]


def _pack(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack(raw) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def short(key: np.ndarray) -> np.ndarray:
    """39 bits of a trigger above a free bit; with the bucket they tell triggers apart well enough to
    find candidates (strings are compared later)."""
    return (key & np.uint64((1 << 39) - 1)) << np.uint64(1)


def by_bucket(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in range(buckets):
        if bounds[b] < bounds[b + 1]:
            yield b, order[bounds[b]:bounds[b + 1]]


def find_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, spans (array of removed [start, end) in bytes), kept (the other bytes) of each row."""
    if length < GRAM or length - GRAM > 62:
        raise ValueError(f"length must be from {GRAM} to {GRAM + 62}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = total_bytes(docs, "text")
    blocks, buckets = max(1, -(-size // BLOCK_BYTES)), max(1, -(-size // BUCKET_BYTES))
    dealt = docs.withColumn("block", F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(blocks))
                            .cast("int")).repartition(blocks, "block")

    def triggers(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        keys, ids = [], []
        for doc_ids, raw, sizes in block_slices(t):
            doc, _, _, key, _ = parse(raw, sizes, length)
            keys.append(key)
            ids.append(doc_ids[doc])
        key, doc = np.concatenate(keys), np.concatenate(ids)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        head = np.ones(len(key), dtype=bool)
        head[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(head)
        several = doc[at] != doc[np.append(at[1:], len(key)) - 1] if len(at) else np.zeros(0, bool)
        key = key[at]
        packed = short(key) | several.astype(np.uint64)
        rows = [(b, block, _pack(packed[i])) for b, i in by_bucket(bucket_of(key, buckets), buckets)]
        return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in
                         enumerate((pa.int32(), pa.int32(), pa.binary()))], ["bucket", "block", "keys"])

    def shared(t: pa.Table) -> pa.Table:
        each = [_unpack(x.as_buffer()) for x in t.column("keys")]
        block = np.repeat(np.arange(len(each)), [len(x) for x in each])
        keys = np.concatenate(each)
        flag = (keys & np.uint64(1)).astype(bool)
        keys >>= np.uint64(1)
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        same = np.zeros(len(k) + 1, dtype=bool)
        same[1:-1] = k[1:] == k[:-1]
        hit = np.empty(len(k), dtype=bool)
        hit[order] = same[1:] | same[:-1]
        # a flag of one block counts for its key in no other block unless that one is hit anyway
        hit |= flag
        bounds = np.searchsorted(block, np.arange(len(each) + 1))
        out = [_pack((keys[a:b] << np.uint64(1))[hit[a:b]]) for a, b in zip(bounds, bounds[1:], strict=False)]
        return pa.table([t.column("block").combine_chunks(), t.column("bucket").combine_chunks(),
                         pa.array(out, pa.binary())], ["block", "bucket", "keys"])

    def dictionary(t: pa.Table, s: pa.Table) -> pa.Table:
        names = ["bucket", "block", "phrase", "doc", "key", "strings", "bytes"]
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        if not t.num_rows or not s.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        block = t.column("block")[0].as_py()
        wanted = np.sort(np.concatenate([_unpack(k.as_buffer()) >> np.uint64(1) | np.uint64(b.as_py() << 39)
                                         for b, k in zip(s.column("bucket"), s.column("keys"), strict=True)]))
        found = []
        for doc_ids, raw, sizes in block_slices(t):
            doc, start, strings, key, phrase = parse(raw, sizes, length)
            bucket = bucket_of(key, buckets)
            full = short(key) >> np.uint64(1) | bucket.astype(np.uint64) << np.uint64(39)
            at = np.minimum(np.searchsorted(wanted, full), max(0, len(wanted) - 1))
            ok = np.flatnonzero(wanted[at] == full) if len(wanted) else np.zeros(0, np.int64)
            size = strings[ok] + length - 1
            found.append((phrase[ok], doc_ids[doc[ok]], key[ok], strings[ok], bucket[ok], size,
                          raw[spread_out(start[ok], size)]))
        phrase, doc, key, strings, bucket, size, raw = (np.concatenate(x) for x in zip(*found, strict=True))
        first = np.cumsum(size) - size
        phrase, one, doc = by_phrase(phrase, doc)
        import zstandard

        rows, pack = [], zstandard.ZstdCompressor(level=1).compress
        for b, i in by_bucket(bucket[one], buckets):
            j = one[i]
            rows.append((b, block, phrase[i].tobytes(), doc[i].tobytes(), key[j].astype(np.uint32).tobytes(),
                         strings[j].astype(np.uint8).tobytes(), pack(raw[spread_out(first[j], size[j])].tobytes())))
        return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    def marks(t: pa.Table) -> pa.Table:
        take = lambda c, kind: np.concatenate([np.frombuffer(x.as_buffer(), dtype=kind) for x in t.column(c)])
        phrase, doc, key = take("phrase", np.uint64), take("doc", np.int64), take("key", np.uint32)
        strings = take("strings", np.uint8).astype(np.int64)
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        raw = np.frombuffer(b"".join([unpack(x.as_py()) for x in t.column("bytes")] + [bytes(8)]), dtype=np.uint8)
        per_block = [len(x.as_buffer()) // 8 for x in t.column("phrase")]
        block = np.repeat(t.column("block").to_numpy(), per_block)
        size = strings + length - 1
        first = np.cumsum(size) - size
        names, one, least = by_phrase(phrase, doc)
        of = np.searchsorted(names, phrase)
        # equal strings have equal triggers; where a trigger has one phrase there is nothing to compare
        order = np.argsort(key[one], kind="stable")
        k = key[one[order]]
        alone = np.ones(len(k) + 1, dtype=bool)
        alone[1:-1] = k[1:] != k[:-1]
        order = order[~(alone[1:] & alone[:-1])]
        one, least_o = one[order], least[order]
        # the 8 bytes from each position as one big-endian number
        wide = np.zeros(len(raw) - 7, dtype=np.uint64)
        for b in range(8):
            wide = wide << np.uint64(8) | raw[b:len(raw) - 7 + b]
        masks = np.zeros(len(one), dtype=np.uint64)
        k, done = key[one], 0
        ends = np.append(np.flatnonzero(k[1:] != k[:-1]) + 1, len(k)) if len(k) else k      # of equal triggers
        upto = np.cumsum(strings[one])
        while done < len(one):
            base = upto[done - 1] if done else 0
            end = ends[max(np.searchsorted(ends, done, side="right"),
                           np.searchsorted(upto[ends - 1], base + CHUNK, side="right") - 1)]
            p = np.arange(done, end)
            own = np.repeat(p, strings[one[p]])
            offset = spread_out(np.zeros(len(p), np.int64), strings[one[p]])
            pos = first[one[own]] + offset
            words = [wide[pos + b] for b in range(0, length - 8, 8)] + [wide[pos + length - 8]]
            s = np.lexsort(words[::-1])                          # suffixes of the dictionary in order
            new = np.ones(len(s), dtype=bool)
            new[1:] = np.any([w[s[1:]] != w[s[:-1]] for w in words], axis=0)
            head = np.flatnonzero(new)
            earliest = np.empty(len(s), dtype=np.int64)
            earliest[s] = np.repeat(np.minimum.reduceat(least_o[own[s]], head), np.diff(np.append(head, len(s))))
            hit = np.flatnonzero(earliest < least_o[own])
            np.bitwise_or.at(masks, own[hit], np.uint64(1) << offset[hit].astype(np.uint64))
            done = end
        mask = np.zeros(len(names), dtype=np.uint64)
        mask[order] = masks
        full = (np.uint64(1) << strings.astype(np.uint64)) - np.uint64(1)
        out = np.where(doc > least[of], full, mask[of])
        some = np.flatnonzero(out)
        rows = [(int(b), phrase[i].tobytes(), out[i].tobytes()) for b, i in
                ((b, some[block[some] == b]) for b in np.unique(block[some]))]
        return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in
                         enumerate((pa.int32(), pa.binary(), pa.binary()))], ["block", "phrase", "mask"])

    def remove(t: pa.Table, m: pa.Table) -> pa.Table:
        names = ["doc_id", "n_bytes", "spans", "kept"]
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = (pa.int64(), pa.int64(), span, pa.binary())
        if not t.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        take = lambda c: np.concatenate([np.zeros(0, np.uint64), *(
            np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in m.column(c))])
        known, mask = take("phrase"), take("mask")
        order = np.argsort(known)
        known, mask = np.append(known[order], 0), np.append(mask[order], 0).astype(np.uint64)
        parsed = [(ids[doc], phrase) for ids, raw, sizes in block_slices(t)
                  for doc, _, _, _, phrase in [parse(raw, sizes, length)]]
        seen, _, least = by_phrase(np.concatenate([p for _, p in parsed]), np.concatenate([d for d, _ in parsed]))
        del parsed
        out = []
        for ids, raw, sizes in block_slices(t):
            doc, start, strings, _, phrase = parse(raw, sizes, length)
            at = np.searchsorted(known[:-1], phrase)
            bits = np.where(known[at] == phrase, mask[at], 0).astype(np.uint64) if len(known) > 1 else \
                np.zeros(len(phrase), np.uint64)
            later = ids[doc] > least[np.searchsorted(seen, phrase)] if len(phrase) else np.zeros(0, bool)
            bits[later] = (np.uint64(1) << strings[later].astype(np.uint64)) - np.uint64(1)
            some = np.flatnonzero(bits)
            pos = spread_out(start[some], strings[some])
            bit = spread_out(np.zeros(len(some), np.int64), strings[some]).astype(np.uint64)
            pos = pos[(np.repeat(bits[some], strings[some]) >> bit & np.uint64(1)).astype(bool)]
            cover = np.zeros(len(raw) + 1, dtype=np.int32)
            cover[pos] += 1                                      # each string begins at one place
            cover[pos + length] -= 1
            gone = np.cumsum(cover[:-1]) > 0
            first = np.cumsum(sizes) - sizes
            for i, (a, n) in enumerate(zip(first.tolist(), sizes.tolist(), strict=True)):
                g = gone[a:a + n]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]])))
                spans = [{"start": s, "end": e} for s, e in edge.reshape(-1, 2).tolist()]
                out.append((ids[i] if ids[i] != LAST else None, n, spans, raw[a:a + n][~g].tobytes()))
        return pa.table([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

    listed = dealt.groupBy("block").applyInArrow(triggers, "bucket int, block int, keys binary")
    common = listed.groupBy("bucket").applyInArrow(shared, "block int, bucket int, keys binary")
    phrases = (dealt.groupBy("block").cogroup(common.groupBy("block")).applyInArrow(
        dictionary, "bucket int, block int, phrase binary, doc binary, key binary, strings binary, bytes binary"))
    marked = phrases.groupBy("bucket").applyInArrow(marks, "block int, phrase binary, mask binary")
    return dealt.groupBy("block").cogroup(marked.groupBy("block")).applyInArrow(
        remove, "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")
