"""Benchmark decontamination by latent semantic retrieval.

1. Documents are cut into overlapping passages of words. The terms are those of the benchmark
   items; their document frequencies are counted over all passages of all documents. A term
   in more than ``common`` of the passages carries no weight; items that keep weight on less
   than WEIGHTED of their words (they are frequent themselves, or the table is small) are also
   searched in a second space, where each of their terms has weight 1.
2. A randomised SVD of the passages' TF-IDF matrix A is computed where the passages lie: for a
   block of items, every partition adds up its part of A^T A Omega and (A Omega)^T (A Omega),
   where Omega holds the items themselves and random columns. From the two sums (their size is
   terms x columns, whatever the corpus) come the leading right singular vectors; the span of
   the items is joined to them, so that truncation cannot lose an item.
3. Each passage's cosine with each item in that space, and the share of the item's own length
   that the passage's projection on it reaches, propose candidates. An item of more than LONG
   words is compared by pieces of a passage's length, as no passage could hold its share.
4. A candidate is checked at the place of the passage that holds most of the item's weighted
   terms: the longest common subsequence of words must cover ``lcs`` of the item, and the
   item's answer must be there: the part behind an answer mark or the last question mark, or
   else the item's weighted terms, ``answer`` of them.

Items are a stated query set; they are taken in blocks of at most ITEM_BLOCK items (fewer where
they hold more than BLOCK_WORDS words) against all documents.

Defined cases: null text has no words and matches nothing; items without words, without id or
null match nothing; texts shorter than a passage are one passage; repeated rows and items are
reported once per pair of ids; rows without doc_id are searched, but not reported; an empty
table gives no pairs.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glint.llm.bpe import spread_out
from glint.llm.common import releasing, slices
from glint.llm.words import hashed_words, text_bytes

PASSAGE, STRIDE = 48, 24       # words
ITEM_BLOCK = 512               # items that share a latent space
LONG = 2 * PASSAGE             # words; longer items are searched piece by piece
BLOCK_WORDS = ITEM_BLOCK * LONG
RANK, EXTRA = 32, 8            # leading singular vectors, and random columns beyond them
WEIGHTED = 0.5                 # an item with less of its words weighted is searched by plain counts too
SLICE_BYTES = 512 << 10
CELLS_AT_ONCE = 1 << 16     # words of places that are looked at together
#: Words are runs of ASCII letters (A-Z as a-z), digits and bytes beyond ASCII.
FOLD = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c > 127 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
BREAKS = np.frombuffer(FOLD, dtype=np.uint8) == 32
BUCKET_SHIFT = np.uint64(44)   # hashes of words are looked up by their first 20 bits
ANSWER = re.compile(r"(?i)(?:^|\n|\s)(?:answer|réponse|antwort|respuesta|a)\s*[:=]\s*")


@dataclass
class Items:
    """A block of benchmark items."""

    ids: list[int]
    words: list[list[bytes]]
    answers: list[list[bytes]]
    terms: dict[bytes, int]          # word -> number

    def columns(self, words: list[bytes]) -> np.ndarray:
        """Term number of each word, -1 for others."""
        return np.fromiter(map(self.terms.get, words, repeat(-1)), np.int64, len(words))


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(FOLD).split() if text else []


def read_items(benchmark: DataFrame) -> Iterator[Items]:
    """The items in blocks, row by row from the table (the driver holds one block)."""
    held: list[tuple[int, str]] = []
    size = 0

    def block() -> Items:
        words = [split_words(t) for _, t in held]
        tails = []
        for _, t in held:
            mark = list(ANSWER.finditer(t))
            tails.append(t[mark[-1].end():] if mark else t.rpartition("?")[2] if "?" in t else "")
        ok = [i for i, w in enumerate(words) if w]
        terms = {w: n for n, w in enumerate(sorted({w for x in words for w in x}))}
        return Items([held[i][0] for i in ok], [words[i] for i in ok], [split_words(tails[i]) for i in ok], terms)

    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter(
        "item_id is not null and text is not null").distinct().orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        more = len(split_words(r[1]))
        if held and (len(held) == ITEM_BLOCK or size + more > BLOCK_WORDS):
            yield block()
            held, size = [], 0
        held.append((r[0], r[1]))
        size += more
    if held:
        yield block()


def passages(words_per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word (in all words) and words of each passage."""
    n = np.maximum(1, -(-(words_per_text - PASSAGE) // STRIDE) + 1) * (words_per_text > 0)
    text = np.repeat(np.arange(len(n)), n)
    k = spread_out(np.zeros(len(n), np.int64), n)
    first = (np.cumsum(words_per_text) - words_per_text)[text] + k * STRIDE
    end = np.minimum(first + PASSAGE, np.cumsum(words_per_text)[text])
    return text, first, end - first


def term_cells(cols: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, term, count) of the terms in each passage, sorted by passage."""
    at = np.flatnonzero(cols >= 0)                         # words that are terms
    a, b = np.searchsorted(at, first), np.searchsorted(at, first + size)
    passage = np.repeat(np.arange(len(first)), b - a)
    key = passage << 32 | cols[at[spread_out(a, b - a)]]
    key, count = np.unique(key, return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, count


def term_finder(items: Items) -> Callable[[np.ndarray], np.ndarray]:
    """The term number of each word by its hash, -1 for others (``check`` compares the words themselves)."""
    raw = np.frombuffer(b" ".join(items.terms), dtype=np.uint8)
    hashes, _ = hashed_words(raw, np.array([len(raw)]), BREAKS)
    order = np.argsort(hashes)
    hashes = hashes[order]
    start = np.searchsorted(hashes >> BUCKET_SHIFT, np.arange((1 << 64 - int(BUCKET_SHIFT)) + 1, dtype=np.uint64))

    def find(words: np.ndarray) -> np.ndarray:
        out = np.full(len(words), -1, dtype=np.int64)
        bucket = (words >> BUCKET_SHIFT).astype(np.int64)
        at, end = start[bucket], start[bucket + 1]
        left = np.flatnonzero(at < end)
        at, end = at[left], end[left]
        while len(left):
            hit = hashes[at] == words[left]
            out[left[hit]] = order[at[hit]]
            at = at + 1
            more = ~hit & (at < end)
            left, at, end = left[more], at[more], end[more]
        return out
    return find


def _text_slices(batches: Iterator[pa.RecordBatch], items: Items):
    """Slices of the texts, the words of each text, and the terms of all words."""
    find = term_finder(items)
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            words, counts = hashed_words(*text_bytes(part.column("text")), BREAKS)
            yield part, counts, find(words)


@dataclass
class View:
    """Term weights, and the items' vectors that are searched by them."""

    weight: np.ndarray
    item: np.ndarray                 # item of each row; a long item has a row per piece
    x: np.ndarray                    # TF-IDF rows of unit length
    length: np.ndarray               # their lengths before
    plain: bool                      # whether each word of the items has weight 1


def document_frequency(texts: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """Passages that hold each term, and all passages."""
    m = len(items.terms)
    held = texts.sparkSession.sparkContext.broadcast(items)      # a block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, df = held.value, np.zeros(m + 1, dtype=np.int64)
        for _, counts, cols in _text_slices(batches, items):
            _, first, size = passages(counts)
            df[:m] += np.bincount(term_cells(cols, first, size)[1], minlength=m)
            df[m] += len(first)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "df"])

    df = np.zeros(m + 1, dtype=np.int64)
    rows = texts.select("text").mapInArrow(releasing(run), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for r in rows.collect():                                     # a row per term
        df[r["term"]] = r["df"]
    return df[:m], max(1, int(df[m]))


def pieces(words: list[bytes]) -> list[list[bytes]]:
    """An item, or a long one's pieces of a passage's length that cover it (the last two may overlap)."""
    n = len(words)
    if n <= LONG:
        return [words]
    return [words[at:at + PASSAGE] for at in [*range(0, n - PASSAGE, PASSAGE), n - PASSAGE]]


def item_views(items: Items, df: np.ndarray, n: int, common: float) -> list[View]:
    """The items' pieces by IDF, and those that keep too little of it once more by plain counts."""
    parts = [(i, x) for i, w in enumerate(items.words) for x in pieces(w)]
    item = np.array([i for i, _ in parts])
    count = np.zeros((len(parts), len(items.terms)))
    for i, (_, w) in enumerate(parts):
        np.add.at(count[i], items.columns(w), 1)
    weight = np.where(df > common * n, 0, np.log((n + 1) / (df + 1)))
    kept = count @ (weight > 0) / count.sum(axis=1)
    poor = kept < WEIGHTED
    out = []
    for w, rows, plain in ((weight, kept > 0, False), (count[poor].any(axis=0).astype(float), poor, True)):
        if rows.any():
            x = count[rows] * w
            length = np.linalg.norm(x, axis=1)
            out.append(View(w, item[rows], x / length[:, None], length, plain))
    return out


def latent_bases(texts: DataFrame, items: Items, views: list[View]) -> list[np.ndarray]:
    """Orthonormal columns (terms x latent) of each view: the items' span and the leading right singular
    vectors of A."""
    m, columns = len(items.terms), RANK + EXTRA
    rng = np.random.default_rng(12345)
    omegas = []
    for view in views:
        omega = rng.standard_normal((m, columns))
        omega[:, :EXTRA] += view.x.T @ rng.standard_normal((len(view.x), EXTRA))
        omegas.append(np.asfortranarray(omega, dtype=np.float32))
    held = texts.sparkSession.sparkContext.broadcast((items, [v.weight for v in views], omegas))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, omegas = held.value
        sums = [(np.zeros((columns, m)), np.zeros((columns, columns))) for _ in weights]
        some = np.any([w > 0 for w in weights], axis=0)
        for _, counts, cols in _text_slices(batches, items):
            _, first, size = passages(counts)
            cells = term_cells(np.where(some[cols], cols, -1), first, size)
            for weight, omega, (y, g) in zip(weights, omegas, sums, strict=True):
                ok = weight[cells[1]] > 0
                p, t = cells[0][ok], cells[1][ok]
                v = (cells[2][ok] * weight[t]).astype(np.float32)
                if not len(p):
                    continue
                head = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
                norm = np.sqrt(np.add.reduceat(v * v, head))                         # passages of unit length
                row = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(p))))
                v /= norm[row]
                a = np.array([np.bincount(row, w[t] * v) for w in omega.T])          # (A Omega)^T of this slice
                g += a @ a.T
                for n, w in enumerate(a):
                    y[n] += np.bincount(t, w[row] * v, m)
        both = np.vstack([a for y, g in sums for a in (y.T, g)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(both))), pa.FixedSizeListArray.from_arrays(
                pa.array(both.ravel()), columns).cast(pa.list_(pa.float64()))], ["row", "v"])

    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    parts = texts.select("text").mapInArrow(releasing(run), "row long, v array<double>")
    summed = (parts.select("row", array_to_vector("v").alias("v")).groupBy("row")
              .agg(Summarizer.sum(F.col("v")).alias("v")).select("row", vector_to_array("v").alias("v")))
    total = np.zeros((len(views), m + columns, columns))
    for r in summed.toLocalIterator():                           # terms + columns rows of each view
        total[divmod(r["row"], m + columns)] = r["v"]
    out = []
    for view, sums in zip(views, total, strict=True):
        y, g = sums[:m], sums[m:]
        # A^T A is about Y G^-1 Y^T: its eigenvectors are the right singular vectors of A
        s, u = np.linalg.eigh((g + g.T) / 2)
        ok = s > 1e-9 * max(s.max(), 1e-300)
        v, _, _ = np.linalg.svd(y @ (u[:, ok] / np.sqrt(s[ok])), full_matrices=False)
        q, r = np.linalg.qr(np.hstack([view.x.T, v[:, :RANK]]))
        out.append(q[:, np.abs(np.diag(r)) > 1e-9])
    return out


def common_subsequence(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, all rows at once in the bits of an integer."""
    where: dict[bytes, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        m = where.get(w)
        if m:
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def check(item: list[bytes], answer: list[bytes], text: list[bytes], at: int, own: frozenset) -> tuple[float, float]:
    """Shares of the item's words and of its answer at the best place near word ``at`` of ``text``.

    ``own``: the item's weighted terms."""
    n = len(item)
    near = text[max(0, at - n):at + PASSAGE + n]
    hit = np.fromiter((w in own for w in near), np.int64, len(near))
    span = min(len(near), n + max(4, n // 3))
    sums = np.cumsum(np.append(0, hit))
    held = sums[span:] - sums[:len(sums) - span]
    best = np.flatnonzero(held == held.max())
    best = int(best[len(best) // 2])                   # the middle of equally good places
    here = near[best:best + span]
    share = common_subsequence(item, here) / n
    if answer:
        return share, common_subsequence(answer, here) / len(answer)
    return share, len(own.intersection(here)) / len(own) if own else share


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.25, cover: float = 0.25, lcs: float = 0.6,
                 answer: float = 0.5, common: float = 0.02) -> DataFrame:
    """doc_id, item_id, similarity (latent cosine), lcs_share, answer_share of each pair that passes."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, similarity double, lcs_share double, answer_share double"
    out = None
    for items in read_items(benchmark):
        if not items.ids:
            continue
        views = item_views(items, *document_frequency(texts, items), common)
        found = _search(texts, items, views, latent_bases(texts, items, views), (cosine, cover, lcs, answer), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], schema)
    # the best place of each pair
    best = F.max(F.struct("lcs_share", "answer_share", "similarity")).alias("b")
    return out.filter("doc_id is not null").groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "b.similarity", "b.lcs_share", "b.answer_share")


def could_hold(pairs: np.ndarray, text: np.ndarray, p: np.ndarray, t: np.ndarray, c: np.ndarray, count: np.ndarray,
               lcs: float) -> np.ndarray:
    """Which (passage, item) pairs have a place near the passage that could pass the subsequence check.

    The cells hold every word of the items. A place of S words starts in some passage k, and k, k + 2, ... of
    its text cover it; what these have in common with the item, counted by word, bounds the subsequence.
    ``count``: words of each item (items x terms)."""
    passages_, n = len(text), count.sum(axis=1)
    share = np.zeros((passages_, len(count)), dtype=np.int32)
    by_term = np.ascontiguousarray(count.T.astype(np.int16))
    cuts = np.unique(np.searchsorted(p, np.arange(0, passages_ + 512, 512)))
    for a, b in zip(cuts, cuts[1:], strict=False):
        head = np.flatnonzero(np.append(True, p[a + 1:b] != p[a:b - 1]))
        share[p[a + head]] = np.add.reduceat(np.minimum(by_term[t[a:b]], c[a:b, None].astype(np.int16)), head, axis=0,
                                             dtype=np.int32)
    start, last = np.searchsorted(text, text), np.searchsorted(text, text, "right") - 1
    span = n + np.maximum(4, n // 3)
    cover = -(-(span + STRIDE) // (2 * STRIDE))
    total = np.zeros_like(share)
    for i in range(int(cover.max())):
        at = np.minimum(np.arange(passages_) + 2 * i, last)
        total += share[at] * (cover > i)
    good = np.zeros((passages_ + 1, len(count)), dtype=np.int32)
    np.cumsum(total >= lcs * n, axis=0, out=good[1:])
    k, j = pairs[:, 0], pairs[:, 1]
    reach = -(-(PASSAGE + n[j]) // STRIDE) + 1
    return good[np.minimum(k + reach, last[k]) + 1, j] > good[np.maximum(k - reach, start[k]), j]


def could_pass(item: np.ndarray, own: np.ndarray, cols: np.ndarray, begin: np.ndarray, end: np.ndarray,
               at: np.ndarray, lcs: float) -> np.ndarray:
    """Which places near the words ``at`` of texts (words ``begin`` to ``end`` of ``cols``) could pass ``check``:
    those whose words hold, counted by word, enough of the item for its subsequence share.

    ``item``: the term of each of its words; ``own``: for each term (and -1) whether the item is searched by it."""
    n = len(item)
    span, width = n + max(4, n // 3), PASSAGE + 2 * n
    words, item_count = np.unique(item, return_counts=True)
    number = np.full(len(own), len(words))                         # of each term among the item's words
    number[words] = np.arange(len(words))
    out = np.zeros(len(at), dtype=bool)
    rows = max(1, CELLS_AT_ONCE // width)
    for a in range(0, len(at), rows):
        lo, hi = np.maximum(begin[a:a + rows], at[a:a + rows] - n), np.minimum(end[a:a + rows], at[a:a + rows] + PASSAGE + n)
        word = lo[:, None] + np.arange(width)
        near = np.where(word < hi[:, None], cols[np.minimum(word, len(cols) - 1)], -1)
        sums = np.zeros((len(lo), width + 1), dtype=np.int32)
        np.cumsum(own[near], axis=1, out=sums[:, 1:])
        held = sums[:, span:] - sums[:, :-span]
        held[np.arange(held.shape[1]) > np.maximum(hi - lo - span, 0)[:, None]] = -1
        seen = np.cumsum(held == held.max(axis=1, keepdims=True), axis=1)
        best = np.argmax(seen > seen[:, -1:] // 2, axis=1)         # the middle of equally good places
        here = number[np.take_along_axis(near, best[:, None] + np.arange(span), axis=1)]
        here += np.arange(len(lo))[:, None] * (len(words) + 1)
        count = np.bincount(here.ravel(), minlength=len(lo) * (len(words) + 1)).reshape(len(lo), -1)[:, :-1]
        out[a:a + rows] = np.minimum(count, item_count).sum(axis=1) / n >= lcs
    return out


def _cuts(p: np.ndarray) -> Iterator[tuple[int, int]]:
    """The cells of a few hundred passages at a time."""
    return pairwise(np.unique(np.searchsorted(p, np.arange(0, p[-1] + 257, 256)))) if len(p) else iter(())


def _shares(view: View) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the view that hold each term, what share of its length a row gets from it, and where each term begins."""
    of_term, row = np.nonzero(view.x.T)
    share = view.x[row, of_term] * view.weight[of_term] / view.length[row]
    return row, share, np.searchsorted(of_term, np.arange(len(view.weight) + 1))


def _proposed(shares: tuple, n_rows: int, p: np.ndarray, t: np.ndarray, c: np.ndarray,
              cover: float) -> tuple[np.ndarray, np.ndarray]:
    """(passage, row of the view) where the passage's projection reaches ``cover`` of the item's length, or nearly so:
    the items' span lies in the space, so the product with an item is that of their terms."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    item, share, first = shares
    held = np.diff(first)
    for a, b in _cuts(p):
        head = np.flatnonzero(np.append(True, p[a + 1:b] != p[a:b - 1]))
        row = np.repeat(np.arange(len(head)), np.diff(np.append(head, b - a)))
        n = held[t[a:b]]
        at = spread_out(first[t[a:b]], n)
        near = np.bincount(np.repeat(row * n_rows, n) + item[at], np.repeat(c[a:b], n) * share[at],
                           len(head) * n_rows).reshape(len(head), n_rows)
        i, j = np.nonzero(near >= cover - 1e-3)                    # ``_cosines`` decides
        found.append((p[a:b][head[i]], j))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _cosines(view: View, rows: np.ndarray, z: np.ndarray, p: np.ndarray, t: np.ndarray, c: np.ndarray, k: np.ndarray,
             j: np.ndarray, cosine: float, cover: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, item, cosine) of the pairs (k, j), in order of k, that are near enough in the space."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
    wanted = np.zeros(p[-1] + 1 if len(p) else 0, dtype=bool)
    wanted[k] = True
    ok = wanted[p]
    p, t, c = p[ok], t[ok], c[ok]
    for a, b in _cuts(p):
        head = np.flatnonzero(np.append(True, p[a + 1:b] != p[a:b - 1]))
        latent = np.add.reduceat(rows[t[a:b]] * c[a:b, None].astype(np.float32), head, axis=0)
        lo, hi = np.searchsorted(k, p[a]), np.searchsorted(k, p[b - 1], side="right")
        at, of = np.searchsorted(p[a:b][head], k[lo:hi]), j[lo:hi]
        near = (latent @ z.T)[at, of]
        enough = near >= cover * view.length[of]
        near /= np.maximum(np.linalg.norm(latent, axis=1), 1e-12)[at]
        ok = enough & (near >= cosine)
        found.append((k[lo:hi][ok], view.item[of[ok]], near[ok]))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _search(texts: DataFrame, items: Items, views: list[View], bases: list[np.ndarray],
            least: tuple[float, float, float, float], schema: str) -> DataFrame:
    spaces = []
    for view, basis in zip(views, bases, strict=True):
        z = view.x @ basis
        z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        spaces.append((view, (basis * view.weight[:, None]).astype(np.float32), z.astype(np.float32)))
    held = texts.sparkSession.sparkContext.broadcast((items, spaces))
    cosine, cover, lcs, answer = least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, spaces = held.value
        shares = [_shares(view) for view, *_ in spaces]
        some = np.any([view.weight > 0 for view, *_ in spaces], axis=0)
        terms: list[set] = [set() for _ in items.ids]               # the terms by which each item is searched
        for view, *_ in spaces:
            for i in view.item:
                terms[i].update(w for w in items.words[i] if view.weight[items.terms[w]] > 0)
        own = [frozenset(x) for x in terms]
        plain = sorted({int(j) for v, *_ in spaces if v.plain for j in v.item})
        place = np.zeros(len(items.ids), dtype=np.int64)
        place[plain] = np.arange(len(plain))
        item_cols = [items.columns(w) for w in items.words]
        count = np.zeros((len(plain), len(items.terms)), dtype=np.int64)
        for i, j in enumerate(plain):
            np.add.at(count[i], item_cols[j], 1)

        def own_terms(j: int) -> np.ndarray:
            mark = np.zeros(len(items.terms) + 1, dtype=bool)      # the last place is that of -1
            mark[items.columns(list(own[j]))] = True
            return mark

        for part, counts, cols in _text_slices(batches, items):
            text, first, size = passages(counts)
            cells = term_cells(np.where(some[cols], cols, -1), first, size)
            end = np.cumsum(counts)
            begin = end - counts
            found = []
            for space, of in zip(spaces, shares, strict=True):
                view = space[0]
                ok = view.weight[cells[1]] > 0
                own_cells = [x[ok] for x in cells]
                k, j = _proposed(of, len(view.item), *own_cells, cover)
                if len(k) and view.plain:                          # common words propose much
                    ok = could_hold(np.column_stack([k, place[view.item[j]]]), text, *cells, count, lcs)
                    k, j = k[ok], j[ok]
                k, j, value = _cosines(*space, *own_cells, k, j, cosine, cover)
                found.append((j << 32 | k, value))
            key, value = map(np.concatenate, zip(*found, strict=True))
            if not len(key):
                continue
            order = np.lexsort((value, key))
            last = np.append(key[order][1:] != key[order][:-1], True)
            key, value = key[order][last], value[order][last]      # the best cosine of each pair
            k, j = key & 0xFFFFFFFF, key >> 32
            doc_ids, texts, out = part.column("doc_id"), part.column("text"), []
            each = functools.lru_cache(maxsize=None)(lambda d, texts=texts: split_words(texts[d].as_py()))
            for a, b in pairwise([*np.flatnonzero(np.append(True, j[1:] != j[:-1])).tolist(), len(j)]):
                n, of = int(j[a]), text[k[a:b]]
                good = could_pass(item_cols[n], own_terms(n), cols, begin[of], end[of], first[k[a:b]], lcs)
                for i in a + np.flatnonzero(good):
                    d = int(text[k[i]])
                    got = check(items.words[n], items.answers[n], each(d), int(first[k[i]] - begin[d]), own[n])
                    if got[0] >= lcs and got[1] >= answer:
                        out.append((doc_ids[d].as_py(), items.ids[n], float(value[i]), *got))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in out], kind) for k, kind in
                     enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))],
                    ["doc_id", "item_id", "similarity", "lcs_share", "answer_share"])

    return texts.mapInArrow(releasing(run), schema)


def without_contamination(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    hit = contaminated(docs, benchmark, **how).select("doc_id").distinct()
    return docs.join(hit, docs["doc_id"] == hit["doc_id"], "left_anti")
