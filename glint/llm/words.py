"""Words and rolling hashes of many texts at once, as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_M = np.uint64


def _mixer() -> np.ndarray:
    """256 fixed pseudo-random odd 64-bit values (splitmix64 of the byte)."""
    z = (np.arange(1, 257, dtype=np.uint64) * _M(0x9E3779B97F4A7C15))
    return mix(z) | _M(1)


def mix(z: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    z = (z ^ (z >> _M(30))) * _M(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _M(27))) * _M(0x94D049BB133111EB)
    return z ^ (z >> _M(31))


BYTE = _mixer()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32                       # A-Z
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True        # \x20 and \x09-\x0D
PUNCT = np.zeros(256, dtype=bool)        # ASCII that is neither letter nor digit
PUNCT[:128] = True
PUNCT[48:58] = PUNCT[65:91] = PUNCT[97:123] = False
BASE, UNBASE = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another (null: none), and the bytes of each."""
    texts = pc.fill_null(texts, "")
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), sizes
    return np.frombuffer(data, dtype=np.uint8)[ends[0]:ends[-1]], sizes


def hashed_words(raw: np.ndarray, sizes: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word (A-Z as a-z; ``breaks`` marks the bytes between words), and words per text."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(sizes), np.int64)
    inside = ~breaks[raw]
    edge = np.zeros(n + 1, dtype=bool)             # a text ends a word
    edge[np.cumsum(sizes)] = True
    edge[0] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE[LOWER[raw]] * powers(BASE, n), dtype=np.uint64, out=total[1:])
    h = (total[last + 1] - total[first]) * powers(UNBASE, n)[first]
    h = mix(h + (last - first).astype(np.uint64) * _M(0x9E3779B97F4A7C15))
    bounds = np.append(0, np.cumsum(sizes))
    return h, np.diff(np.searchsorted(first, bounds))


def shingles(words: np.ndarray, counts: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text; a shorter text is one shingle."""
    n = len(words)
    h = np.zeros(max(0, n - k + 1), dtype=np.uint64)
    for i in range(k):
        h += words[i:n - k + 1 + i] * _M(pow(BASE, i + 1, 1 << 64)) if n >= k else _M(0)
    h = mix(h)
    out, at = [], 0
    for c in counts.tolist():
        if c >= k:
            out.append(np.unique(h[at:at + c - k + 1]))
        elif c:
            w = (words[at:at + c] * powers(BASE, c)).sum(dtype=np.uint64)
            out.append(mix(np.array([w + _M(c)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out
