"""Alignment of two tokenizers: where their tokens end at the same byte, and which ids that links.

Both tokenizers give a span for each token: characters of one, bytes of the other. The ends of the
spans are coarse cuts: tokens that share a multibyte character, and byte-fallback tokens, end at
the same place or have no span of their own. Within such a run the ends are refined backwards from
the cut by the lengths of the tokens' decoded bytes. A text whose decoded bytes are not those of the
text has no tokens; spans that disagree with the decoded bytes (trimmed ones) give way to them.

The tokens between two cuts that both tokenizers share are a group; every token of one is linked with
every token of the other. Both tokenizers end a token before a single space between two other
characters (checked: one splits into words first, the other's vocabulary has no such piece), so texts are cut there and a worker encodes and groups each distinct
part once, as long as its bounded table holds it. The number of documents that hold a pair of ids is counted over the whole
corpus: a block of documents is encoded once and written with its distinct pairs, the pairs are
summed by a grouping (partial sums first), and the totals come back to the blocks by a join.

Defined cases: null or empty texts, and texts that a tokenizer changes (normalised characters, say),
have no tokens: zeros and an empty digest. A null id is carried. Repeated rows are documents of
their own. Of pairs with equal counts all are best. A text is encoded whole, however long (the
memory of a task grows with its longest text). An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glint.llm.bpe import spread_out
from glint.llm.common import releasing, slices, stored
from glint.llm.interpolation import pack, unpack

BLOCK_BYTES = 16 << 20     # text whose pairs are counted together
SLICE_BYTES = 1 << 20      # text that is encoded at a time
KNOWN_PARTS = 600_000      # distinct parts of texts that a worker remembers
PAIRS_AT_ONCE = 4_000_000  # links that are spread out at a time

BLOCK_ROWS = ("block long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, "
              "n_links array<long>, digests array<string>, sizes array<long>, place binary, times binary, "
              "codes array<long>, held array<long>")
ALIGNED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
           "groups_sha256 string")


def byte_letters() -> dict[str, int]:
    """Letter -> byte of byte-level vocabularies: printable Latin-1 stands for itself, the other bytes
    for the letters from U+0100 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b and b != 173]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Coder:
    """A tokenizer with the decoded bytes of its ids: ``encode`` gives ids and span ends of each text.

    ``apart``: no token holds a space after another character, so a text may be cut before a single space.
    """

    apart = False

    def __init__(self, token_bytes: list[bytes]):
        self.token_bytes = token_bytes
        self.size = np.array([len(t) for t in token_bytes], dtype=np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.all_bytes = np.frombuffer(b"".join(token_bytes), dtype=np.uint8)

    def same_bytes(self, ids: np.ndarray, part: np.ndarray, raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether the decoded bytes of the tokens of each part are its bytes; the parts lie one after another in ``raw``."""
        n = len(sizes)
        size = self.size[ids]
        good = np.bincount(part, size, n) == sizes
        of = good[part]
        decoded = self.all_bytes[spread_out(self.first[ids[of]], size[of])]
        owner = np.repeat(np.arange(n), np.where(good, sizes, 0))
        return good & (np.bincount(owner, decoded != raw[np.repeat(good, sizes)], n) == 0)


class ByteLevel(Coder):
    """A byte-level BPE of the tokenizers library; spans count characters."""

    def __init__(self, file: bytes):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task has one core
        self.coder = Tokenizer.from_buffer(file)
        self.coder.encode_special_tokens = True              # their strings in a text are plain text
        letter = byte_letters()
        names = [""] * self.coder.get_vocab_size(with_added_tokens=True)
        for name, i in self.coder.get_vocab(with_added_tokens=True).items():
            names[i] = name
        super().__init__([bytes(letter[c] for c in n) for n in names])
        words = json.loads(file)
        pre = words.get("pre_tokenizer") or {}
        self.apart = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not words.get("normalizer")

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        found = self.coder.encode_batch([" " + t for t in texts], add_special_tokens=False)
        return [e.ids for e in found], [[end for _, end in e.offsets] for e in found]

    @staticmethod
    def cuts(ends: np.ndarray, text: np.ndarray, raw: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Byte ends from character ends; ``text``: each token's text, ``first``: first byte of each text."""
        begins = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        return begins[np.searchsorted(begins, first)[text] + ends]


class Pieces(Coder):
    """A sentencepiece model with byte fallback that adds a space in front; spans count bytes."""

    def __init__(self, file: bytes):
        import sentencepiece

        self.coder = sentencepiece.SentencePieceProcessor(model_proto=file)
        n = range(self.coder.get_piece_size())
        super().__init__([bytes([int(p[3:5], 16)]) if self.coder.is_byte(i) else
                          p.replace("▁", " ").encode() for i, p in zip(n, map(self.coder.id_to_piece, n),
                                                                            strict=True)])
        self.apart = all(b" " not in t.lstrip(b" ") for t in self.token_bytes)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        # ids and spans of the library's proto, as plain lists (it no longer hands out immutable protos)
        found = self.coder.encode(texts, return_type="offset_mapping", return_bytes=True, num_threads=1)
        return [f["ids"] for f in found], [[end + 1 for _, end in f["offsets"]] for f in found]

    @staticmethod
    def cuts(ends: np.ndarray, text: np.ndarray, raw: np.ndarray, first: np.ndarray) -> np.ndarray:
        return first[text] + ends


@functools.lru_cache(maxsize=4)
def coder(kind: type, file: bytes) -> Coder:
    """The tables of a vocabulary; a worker builds them once for all of its tasks."""
    return kind(file)


def refine(cuts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends of tokens from coarse cuts: of a run of tokens with one cut, the last ends there, and
    each one before it ends where the decoded bytes of its successors in the run begin."""
    if not len(cuts):
        return cuts
    total = np.cumsum(sizes)
    last = np.append(np.flatnonzero(cuts[1:] != cuts[:-1]), len(cuts) - 1)
    last = np.repeat(last, np.diff(np.append(-1, last)))
    return cuts - (total[last] - total)


def token_ends(tok: Coder, ids: np.ndarray, spans: np.ndarray, text: np.ndarray, raw: np.ndarray,
               first: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Byte ends of the tokens of texts that lie one after another in ``raw``; ``known`` marks texts with tokens."""
    size = tok.size[ids]
    ends = refine(tok.cuts(spans, text, raw, first), size)
    start = np.cumsum(np.where(known, np.diff(np.append(first, len(raw))), 0))
    decoded = np.cumsum(size) - np.append(0, start)[text] + first[text]
    odd = np.bincount(text, ends != decoded, len(first)) > 0      # spans that the decoded bytes contradict
    return np.where(odd[text], decoded, ends)


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 .. n - 1, each followed by room for one more character, and their numbers."""
    width = len(str(max(0, n - 1))) + 1
    raw = b"".join(str(i).encode().ljust(width, b"\0") for i in range(n))
    rows = np.frombuffer(raw, dtype=np.uint8).reshape(n, width)
    return rows, (rows > 0).sum(axis=1)


class Aligned:
    """Groups and links of parts of texts (each stands after a space)."""

    def __init__(self, a: Coder, b: Coder):
        self.a, self.b = a, b
        self.bits = max(1, (len(b.token_bytes) - 1).bit_length())
        self.digits, self.width = _digits(max(len(a.token_bytes), len(b.token_bytes)))
        self.split = re.compile(r"(?<=\S) (?=\S)").split if a.apart and b.apart else lambda t: [t]

    def parts(self, parts: list[str]) -> tuple[dict[str, np.ndarray], list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Of each part whether both tokenizers keep its bytes, its numbers, and its groups as ``a1,a2|b1;a3|b2,b3``;
        and the distinct pairs of all parts in order, their numbers of links, and the pairs of each part."""
        n = len(parts)
        raws = [b" " + t.encode() for t in parts]
        raw = np.frombuffer(b"".join(raws), dtype=np.uint8)
        sizes = np.array([len(r) for r in raws], dtype=np.int64)
        first = np.cumsum(sizes) - sizes
        good, sides = np.ones(n, dtype=bool), []
        for tok in (self.a, self.b):
            ids, spans = tok.encode(parts)
            text = np.repeat(np.arange(n), [len(x) for x in ids])
            ids, spans = (np.fromiter(chain.from_iterable(x), np.int64, len(text)) for x in (ids, spans))
            good &= tok.same_bytes(ids, text, raw, sizes)
            sides.append((tok, ids, spans, text))
        flat = []
        for tok, ids, spans, text in sides:
            of = good[text]
            ids, spans, text = ids[of], spans[of], text[of]
            flat.append((ids, token_ends(tok, ids, spans, text, raw, first, good), np.bincount(text, minlength=n)))
        (a, ends_a, n_a), (b, ends_b, n_b) = flat
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        in_a, in_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        size_a, size_b = np.bincount(in_a, minlength=len(shared)), np.bincount(in_b, minlength=len(shared))
        of_part = np.searchsorted(first, shared - 1, side="right") - 1
        per = lambda v: np.bincount(of_part, v, n).astype(np.int64)
        numbers = {"ok": good, "n_a": n_a, "n_b": n_b, "n_groups": per(np.ones(len(shared))),
                   "n_links": per(size_a * size_b)}
        codes, times = self._pairs(a, b, size_a, size_b, of_part)
        return (numbers, self._lines(a, b, in_a, in_b, size_a, size_b, n_a + n_b), codes & PAIR, times,
                np.bincount(codes >> 40, minlength=n))

    def _lines(self, a, b, in_a, in_b, size_a, size_b, tokens) -> list[bytes]:
        through_a, through_b = np.cumsum(size_a), np.cumsum(size_b)
        ids = np.zeros(len(a) + len(b), dtype=np.int64)
        mark = np.full(len(ids), ord(","), dtype=np.uint8)
        ids[np.arange(len(a)) + (through_b - size_b)[in_a]] = a
        ids[np.arange(len(b)) + through_a[in_b]] = b
        mark[through_a + through_b - size_b - 1] = ord("|")
        mark[through_a + through_b - 1] = ord(";")
        width = self.width[ids]
        rows = self.digits[ids]
        rows[np.arange(len(ids)), width] = mark
        line = rows[np.arange(rows.shape[1]) <= width[:, None]].tobytes()
        ends = np.append(0, np.cumsum(width + 1))[np.append(0, np.cumsum(tokens))].tolist()
        return [line[i:j - 1] if i < j else b"" for i, j in zip(ends, ends[1:], strict=False)]

    def _pairs(self, a, b, size_a, size_b, text) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text << 40 | a << bits | b) of all links, sorted, and how many links each stands for."""
        first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        cut = np.cumsum(np.append(0, size_b[np.repeat(np.arange(len(size_a)), size_a)]))
        group = np.repeat(np.arange(len(size_a)), size_a)          # of each token of a
        lo = 0
        while lo < len(a):
            hi = max(lo + 1, int(np.searchsorted(cut, cut[lo] + PAIRS_AT_ONCE, side="right")) - 1)
            g = group[lo:hi]
            left = np.repeat((text[g] << 40) | (a[lo:hi] << self.bits), size_b[g])
            found.append(_tallied(left | b[spread_out(first_b[g], size_b[g])]))
            lo = hi
        return _tallied(*map(np.concatenate, zip(*found, strict=True)))


def _tallied(codes: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and how often each occurs (or the sums of ``times``)."""
    if times is None:
        codes = np.sort(codes)
    else:
        order = np.argsort(codes, kind="stable")
        codes, times = codes[order], times[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    if times is None:
        return codes[first], np.diff(np.append(first, len(codes)))
    return codes[first], np.add.reduceat(times, first) if len(first) else times


PAIR = (1 << 40) - 1
NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


class Known(dict):
    """Part of a text -> its number in order of appearance; what ``Aligned`` says of it follows on ``learn``."""

    def __init__(self, work: Aligned):
        super().__init__()
        self.work, self.new = work, []
        self.numbers = {k: np.zeros(0, np.int64) for k in ("ok", *NUMBERS)}
        self.lines: list[bytes] = []
        self.codes, self.times, self.first, self.count = (np.zeros(0, np.int64) for _ in range(4))

    def __missing__(self, part: str) -> int:
        self[part] = at = len(self.lines) + len(self.new)
        self.new.append(part)
        return at

    def learn(self) -> None:
        for at in range(0, len(self.new), 20_000):
            numbers, lines, codes, times, count = self.work.parts(self.new[at:at + 20_000])
            self.numbers = {k: np.append(v, numbers[k]) for k, v in self.numbers.items()}
            self.lines += lines
            self.first = np.append(self.first, len(self.codes) + np.cumsum(count) - count)
            self.count = np.append(self.count, count)
            self.codes, self.times = np.append(self.codes, codes), np.append(self.times, times)
        self.new = []

    def texts(self, texts: list) -> tuple[dict[str, np.ndarray], list[str], np.ndarray, np.ndarray]:
        """Numbers by text, digests, and the distinct (text << 40 | pair) of all texts with their links."""
        at = [list(map(self.__getitem__, self.work.split(t))) if t else [] for t in texts]
        self.learn()
        size = np.array([len(x) for x in at], dtype=np.int64)
        part = np.fromiter(chain.from_iterable(at), np.int64, int(size.sum()))
        ends = np.cumsum(size)

        def per_text(v: np.ndarray) -> np.ndarray:
            upto = np.append(0, np.cumsum(v[part]))
            return upto[ends] - upto[ends - size]
        good = (per_text(1 - self.numbers["ok"]) == 0) & (size > 0)
        numbers = {k: per_text(self.numbers[k]) * good for k in NUMBERS}
        line = self.lines.__getitem__
        digests = [hashlib.sha256(b";".join(map(line, x))).hexdigest() if ok else ""
                   for x, ok in zip(at, good.tolist(), strict=True)]
        text = np.repeat(np.arange(len(texts)), size)
        part, text = part[good[text]], text[good[text]]
        place = spread_out(self.first[part], self.count[part])
        return numbers, digests, *_tallied((np.repeat(text, self.count[part]) << 40) | self.codes[place], self.times[place])


def encode_blocks(docs: DataFrame, file_a: bytes, file_b: bytes) -> DataFrame:
    """Blocks of documents with their numbers, digests and pairs (see ``BLOCK_ROWS``), written once."""
    held = docs.sparkSession.sparkContext.broadcast((file_a, file_b))

    def run(batches):
        work = Aligned(coder(ByteLevel, held.value[0]), coder(Pieces, held.value[1]))
        task, number, known = TaskContext.get().partitionId(), 0, Known(work)

        def row(parts):
            ids, numbers, digests, codes, times = zip(*parts, strict=True)
            sizes = [len(i) for i in ids]
            start = np.repeat(np.cumsum(sizes) - sizes, [len(c) for c in codes])
            codes = np.concatenate(codes)
            pair, text = codes & PAIR, (codes >> 40) + start
            distinct, docs_of = _tallied(pair)
            n = sum(sizes)
            one = {"block": (task << 32) + number, "ids": sum(ids, []), "digests": sum(digests, []),
                   "sizes": np.bincount(text, minlength=n), "place": pack(np.searchsorted(distinct, pair)),
                   "times": pack(np.concatenate(times)), "codes": distinct, "held": docs_of}
            one |= {k: np.concatenate([x[k] for x in numbers]) for k in NUMBERS}
            types = {"block": pa.int64(), "digests": pa.list_(pa.string()), "place": pa.binary(), "times": pa.binary()}
            names = [f.split()[0] for f in BLOCK_ROWS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([one[k]], types.get(k, pa.list_(pa.int64()))) for k in names],
                                              names=names)

        parts, size = [], 0
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                parts.append((part.column("doc_id").to_pylist(), *known.texts(part.column("text").to_pylist())))
                size += part.column("text").nbytes
                if len(known) > KNOWN_PARTS:
                    known = Known(work)
                if size >= BLOCK_BYTES:
                    yield row(parts)
                    parts, size, number = [], 0, number + 1
        if parts:
            yield row(parts)

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return stored(d.mapInArrow(releasing(run), BLOCK_ROWS), "aligned-blocks")


def pair_counts(blocks: DataFrame, bits: int) -> DataFrame:
    """``a, b, code, n, best``: of each linked pair of ids the documents that hold it, and whether no pair of
    its ``a`` is held by more. The highest count of each a joins by broadcast: the vocabulary bounds it."""
    n = (blocks.select(F.explode(F.arrays_zip("codes", "held")).alias("x"))
         .groupBy(F.col("x.codes").alias("code")).agg(F.sum("x.held").alias("n")))
    n = n.withColumn("a", F.shiftright("code", bits)).withColumn("b", F.col("code").bitwiseAND((1 << bits) - 1))
    most = n.groupBy("a").agg(F.max("n").alias("most"))
    return n.join(F.broadcast(most), "a").withColumn("best", F.col("n") == F.col("most")).drop("most")


def align(docs: DataFrame, file_a: bytes, file_b: bytes) -> DataFrame:
    """``ALIGNED`` columns of every row of ``docs`` (``doc_id``, ``text``).

    ``file_a``: bytes of a byte-level BPE file of the tokenizers library, given the text after a space;
    ``file_b``: bytes of a sentencepiece model that adds the space itself. Token ids of both need up to 20 bits.
    """
    blocks = encode_blocks(docs, file_a, file_b)
    bits = Aligned(coder(ByteLevel, file_a), coder(Pieces, file_b)).bits
    counts = pair_counts(blocks, bits).select("code", "n", "best")
    pairs = blocks.select(F.col("block").alias("of_block"), F.explode("codes").alias("code"))
    found = pairs.join(counts, "code").select("of_block", "code", "n", "best")
    names = [f.split()[0] for f in ALIGNED.split(", ")]
    schema = pa.schema([(k, pa.string() if k == "groups_sha256" else pa.int64()) for k in names])

    def finish(block: pa.Table, found: pa.Table) -> pa.Table:
        if not len(block):
            return schema.empty_table()
        one = block.to_pylist()[0]
        found = found.sort_by("code")
        n, best = found.column("n").to_numpy(), found.column("best").to_numpy().astype(np.int64)
        place, times = unpack(one["place"]).astype(np.int64), unpack(one["times"]).astype(np.int64)
        ends = np.cumsum(one["sizes"])
        total = {}
        for name, v in (("n_best", best), ("count_sum", n)):
            upto = np.append(0, np.cumsum(v[place] * times if len(place) else times))
            total[name] = upto[ends] - upto[np.append(0, ends[:-1])]
        cols = [one["ids"], one["n_a"], one["n_b"], one["n_groups"], one["n_links"], total["n_best"],
                total["count_sum"], one["digests"]]
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    rest = blocks.drop("codes", "held")
    return rest.groupBy("block").cogroup(found.groupBy("of_block")).applyInArrow(finish, ALIGNED)
