"""Byte-level BPE encoding and decoding by merge replay over a block of the corpus.

The distinct words (pattern matches) of a block of documents are laid out as one array
of tokens. An inverted index maps each mergeable pair, by the rank of what it merges
into, to the positions where it begins. The ranks are replayed in ascending order; a
rank merges at all of its positions at once, and only the neighbours that a merge
touched are looked up and indexed anew. Words do not influence each other, so blocks need
no exchange, and a worker replays a word once as long as its bounded table holds it.

Defined cases: null text is empty text (no ids, no bytes); every other column, also null
ones, passes through unchanged; an existing ``ids`` / ``decoded`` column is replaced;
repeated rows stay repeated; an empty table gives an empty table with the output schema.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from glint.llm.common import releasing, schema_with, slices

BLOCK_BYTES = 4 << 20      # text whose new words are replayed together
SLICE_BYTES = 2 << 20      # text that is split into words at a time
KNOWN_WORDS = 300_000      # distinct words a worker remembers


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes -> rank, from the text of a ``.tiktoken`` file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


def spread_out(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions first[i] .. first[i] + size[i] - 1 of all i, one after another."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(first - (ends - size), size) + np.arange(total)


class MergeReplay:
    """Tables of one vocabulary, and the replay of its merges."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        top = max(ranks.values()) + 1
        tokens = [b""] * top
        for t, i in ranks.items():
            tokens[i] = t
        self.token_size = np.array([len(t) for t in tokens], dtype=np.int64)
        self.token_first = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.shift = top
        pairs = {}
        for t, i in ranks.items():
            for cut in range(1, len(t)):
                a, b = ranks.get(t[:cut]), ranks.get(t[cut:])
                if a is not None and b is not None:
                    pairs[a * top + b] = i
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int32)

    def lookup(self, left, right) -> np.ndarray:
        """Rank that each pair merges into, or -1."""
        key = np.asarray(left, dtype=np.int64) * self.shift + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def one(self, word: bytes) -> list[int]:
        """A word on its own: lowest rank first, leftmost first."""
        tok = self.single[np.frombuffer(word, dtype=np.uint8)].tolist()
        while len(tok) > 1:
            rank = self.lookup(np.array(tok[:-1]), np.array(tok[1:]))
            if rank.max() < 0:
                break
            i = int(np.argmin(np.where(rank < 0, self.shift, rank)))
            tok[i:i + 2] = [int(rank[i])]
        return tok

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the number of ids of each word."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        n = len(raw)
        if not n:
            return np.zeros(0, np.int64), size
        start = np.cumsum(size) - size
        place = np.int32                                   # a block is far below 2 GB
        tok = np.append(self.single[raw], place(-1))
        nxt = np.append(np.arange(1, n + 1, dtype=place), place(n))            # n: no neighbour
        nxt[start[size > 0] + size[size > 0] - 1] = n
        prv = np.append(np.arange(-1, n - 1, dtype=place), place(n))
        prv[start[size > 0]] = n
        now = np.full(n + 1, -1, dtype=place)              # rank of the pair that begins here
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []
        odd: list[np.ndarray] = []

        def add(pos: np.ndarray, rank: np.ndarray) -> None:
            now[pos] = rank
            ok = rank >= 0
            pos, rank = pos[ok].astype(place), rank[ok]
            if not len(pos):
                return
            if len(pos) > 1:
                order = np.argsort(rank, kind="stable")
                pos, rank = pos[order], rank[order]
                cuts = (np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist()
            else:
                cuts = []
            a = 0
            for b in [*cuts, len(pos)]:
                r = int(rank[a])
                held = index.get(r)
                if held is None:
                    index[r] = [pos[a:b]]
                    heapq.heappush(heap, r)
                else:
                    held.append(pos[a:b])
                a = b

        pos = np.flatnonzero(nxt[:n] < n)
        add(pos, self.lookup(tok[pos], tok[pos + 1]))
        while heap:
            r = heapq.heappop(heap)
            held = index.pop(r)
            p = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            p = p[now[p] == r]                             # others lost a token to a lower rank
            if not len(p):
                continue
            if len(p) > 1:
                chain = p[1:] == nxt[p[:-1]]
                if chain.any():                            # overlapping pairs: every other one, from the left
                    k = np.arange(len(p))
                    head = np.maximum.accumulate(np.where(np.append(False, chain), 0, k))
                    p = p[(k - head) % 2 == 0]
            j = nxt[p]
            after = nxt[j]
            tok[p], tok[j], now[j], now[p] = r, -1, -1, -1
            nxt[p], prv[after] = after, p
            right = after < n
            pr = p[right]
            mr = self.lookup(np.int64(r), tok[after[right]])
            before = prv[p]
            pl = before[before < n]
            ml = self.lookup(tok[pl], np.int64(r))
            for pos, m in ((pr, mr), (pl, ml)):
                low = (m >= 0) & (m < r)
                if low.any():
                    odd.append(pos[low])
                add(pos, m)
        alive = tok[:n] >= 0
        flat = tok[:n][alive]
        count = np.diff(np.append(0, np.cumsum(alive))[np.append(start, n)])
        if odd:      # a merge made a pair of lower rank: such words are replayed on their own
            parts = np.split(flat, np.cumsum(count)[:-1])
            for w in np.unique(np.searchsorted(start, np.concatenate(odd), side="right") - 1).tolist():
                parts[w] = np.array(self.one(words[w]), dtype=np.int64)
                count[w] = len(parts[w])
            flat = np.concatenate(parts)
        return flat, count

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids one after another, and the number of bytes of each id."""
        size = self.token_size[ids]
        return self.token_bytes[spread_out(self.token_first[ids], size)], size


@functools.lru_cache(maxsize=2)
def tables(rank_file: bytes) -> MergeReplay:
    """The tables of a vocabulary; a worker builds them once for all of its tasks."""
    return MergeReplay(read_ranks(rank_file))


class Words(dict):
    """Word -> number in order of appearance; the ids of a word follow when it has been replayed."""

    def __init__(self, replay: MergeReplay):
        super().__init__()
        self.replay, self.done = replay, 0
        self.flat, self.first, self.count = (np.zeros(0, np.int64) for _ in range(3))
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = at = self.done + len(self.new)
        self.new.append(word)
        return at

    def learn(self) -> None:
        """Replay the words that came since the last call. A word that is a token needs no merge."""
        if not self.new:
            return
        raw = [w.encode("utf-8") for w in self.new]
        whole = np.array([self.replay.ranks.get(w, -1) for w in raw], dtype=np.int64)
        flat, count = self.replay.replay([w if i < 0 else b"" for w, i in zip(raw, whole.tolist(), strict=True)])
        first = np.cumsum(count) - count
        token = np.flatnonzero(whole >= 0)
        first[token], count[token] = len(flat) + np.arange(len(token)), 1
        self.first = np.append(self.first, first + len(self.flat))
        self.count = np.append(self.count, count)
        self.flat = np.concatenate([self.flat, flat, whole[token]])
        self.done += len(self.new)
        self.new = []


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [c for c in batch.schema.names if c.lower() != name.lower()]
    return pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [values], [*kept, name])


def _ends(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))


def encode_documents(docs: DataFrame, rank_file: bytes, pattern: str, text: str = "text",
                     ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text`` as ``ids array<int>``.

    ``rank_file``: the bytes of a ``.tiktoken`` file (a fixed vocabulary, sent as one
    broadcast variable). ``pattern``: the regular expression whose matches are encoded
    separately. No special tokens.
    """
    held = docs.sparkSession.sparkContext.broadcast(rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split, replay = regex.compile(pattern).findall, tables(held.value)
        words = Words(replay)

        def coded(block: list) -> Iterator[pa.RecordBatch]:
            words.learn()
            for part, numbers, sizes in block:
                count = words.count[numbers]
                flat = words.flat[spread_out(words.first[numbers], count)].astype(np.int32)
                doc = np.diff(np.append(0, np.cumsum(count))[np.append(0, np.cumsum(sizes))])
                yield _with(part, ids, pa.ListArray.from_arrays(_ends(doc), pa.array(flat)))

        block, size = [], 0
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                numbers, sizes = [], []
                for t in part.column(text).to_pylist():
                    found = split(t) if t else []
                    sizes.append(len(found))
                    numbers.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
                block.append((part, np.concatenate(numbers), np.array(sizes, dtype=np.int64)))
                size += part.column(text).nbytes
                if size >= BLOCK_BYTES:
                    yield from coded(block)
                    block, size = [], 0
                    if len(words) > KNOWN_WORDS:
                        words = Words(replay)
        yield from coded(block)

    return docs.mapInArrow(releasing(run), schema_with(docs, **{ids: T.ArrayType(T.IntegerType())}))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and sizes of a list column; null lists are empty."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), sizes.astype(np.int64)


def decode_documents(encoded: DataFrame, rank_file: bytes, ids: str = "ids", decoded: str = "decoded",
                     digest: str | None = None) -> DataFrame:
    """``encoded`` with the bytes that its ``ids`` stand for (null ids: no bytes) as ``decoded binary``.

    ``digest`` names a further column: the hex SHA-256 of the ids as little-endian unsigned 32-bit integers.
    """
    held = encoded.sparkSession.sparkContext.broadcast(rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        replay = tables(held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                flat, sizes = _flat(part.column(ids))
                raw, each = replay.decode(flat)
                size = np.diff(np.append(0, np.cumsum(each))[np.append(0, np.cumsum(sizes))])
                out = _with(part, decoded, pa.Array.from_buffers(
                    pa.binary(), part.num_rows, [None, _ends(size).buffers()[1], pa.py_buffer(raw.tobytes())]))
                if digest:
                    raw, ends = memoryview(flat.astype("<u4").tobytes()), (4 * np.cumsum(sizes)).tolist()
                    hexes = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip([0, *ends], ends, strict=False)]
                    out = _with(out, digest, pa.array(hexes, pa.string()))
                yield out

    new = {decoded: T.BinaryType()} | ({digest: T.StringType()} if digest else {})
    return encoded.mapInArrow(releasing(run), schema_with(encoded, **new))
