"""64-bit hashes of the words of many texts at once, with numpy over Arrow buffers.

A word's hash is a polynomial over a random byte table, taken for all words from
one running sum; A-Z share the entries of a-z, so hashes ignore ASCII case.
Texts are handled in blocks cut at white space, so the temporaries stay small
however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
_TABLE[65:91] = _TABLE[97:123]
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and their n + 1 offsets; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


_POW, _INV = _powers(_BASE, BLOCK), _powers(_INVERSE, BLOCK)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word, and the n + 1 word offsets of the texts."""
    hashes, starts, ends = [], [], []
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    at = 0
    while at < n:
        stop = min(at + BLOCK, n)
        while stop < n:  # to the last place where no word is cut
            cut = np.flatnonzero(~_IS_WORD[data[at:stop]] | edge[at + 1: stop + 1])
            if len(cut):
                stop = at + int(cut[-1]) + 1
                break
            stop = min(stop + BLOCK, n)
        block, size = data[at:stop], stop - at
        word = _IS_WORD[block]
        begins, finishes = word.copy(), word.copy()
        begins[1:] &= ~word[:-1] | edge[at + 1: stop]
        finishes[:-1] &= ~word[1:] | edge[at + 1: stop]
        s, e = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
        pows, inverse = (_POW, _INV) if size <= BLOCK else (_powers(_BASE, size), _powers(_INVERSE, size))
        run = np.zeros(size + 1, np.uint64)
        np.cumsum(_TABLE[block] * pows[:size], out=run[1:])
        h = (run[e] - run[s]) * inverse[s]
        hashes.append(mix(h ^ ((e - s).astype(np.uint64) << np.uint64(48))))
        starts.append(s + at)
        ends.append(e + at)
        at = stop
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    starts = join(starts, np.int64)
    return join(hashes, np.uint64), starts, join(ends, np.int64), np.searchsorted(starts, offsets)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word windows of a word sequence."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += words[j: j + n]
    return mix(h)


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 * BLOCK) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text, one row at least."""
    _, offsets = text_buffers(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last
