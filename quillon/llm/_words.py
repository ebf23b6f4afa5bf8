"""Vectorised word scanning over Arrow string buffers.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D.  All of these
separators are single bytes in UTF-8, so scanning bytes is exact.  A word is
known by a 64-bit polynomial hash of its bytes with a final mix; two different
words agree with probability about 2**-64, which is the only way in which the
operators built on these hashes are inexact.

Nulls count as empty texts.  Texts of any length are scanned whole; batches
are cut into chunks of documents so that memory follows the longest document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Work on a chunk takes some fifty times its bytes.
CHUNK_BYTES = 1 << 18

_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, size=256, dtype=np.uint64) | np.uint64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)


def _pow(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 256), _BASE, dtype=np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
    return _powers


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of n + 1 documents) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges [i, j) of documents of about ``limit`` bytes, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


class Words:
    """Words of documents i..j-1 of a batch: byte spans, counts and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, i: int, j: int):
        base = int(offsets[i])
        self.n_docs = j - i
        self.data = data[base : int(offsets[j])]
        offs = offsets[i : j + 1] - base
        size = len(self.data)
        if size == 0:
            self.starts = self.ends = np.zeros(0, np.int64)
        else:
            token = ~_SEP[self.data]
            edge = np.zeros(size + 1, dtype=bool)
            edge[offs] = True
            first = token.copy()
            first[1:] &= ~token[:-1] | edge[1:size]
            last = token.copy()
            last[:-1] &= ~token[1:] | edge[1:size]
            self.starts = np.flatnonzero(first)
            self.ends = np.flatnonzero(last) + 1
        #: Document k has words first_word[k] .. first_word[k + 1] - 1.
        self.first_word = np.searchsorted(self.starts, offs, side="left")
        self.first_word[-1] = len(self.starts)
        self.counts = np.diff(self.first_word)

    def hashes(self, fold_ascii: bool = False) -> np.ndarray:
        """One hash a word; fold_ascii takes A-Z as a-z."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lens = self.ends - self.starts
        begin = np.cumsum(lens) - lens
        total = int(lens.sum())
        pos = np.arange(total, dtype=np.int64) - np.repeat(begin, lens)
        at = pos + np.repeat(self.starts, lens)
        table = _FOLDED if fold_ascii else _BYTE
        part = table[self.data[at]] * _pow(int(lens.max()))[pos]
        return mix64(np.add.reduceat(part, begin) + lens.astype(np.uint64))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes (order matters)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= _BASE
        out += hashes[k : k + n]
    return mix64(out)


def rolling_long(hashes: np.ndarray, width: int) -> np.ndarray:
    """As rolling() by prefix sums; for wide windows."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power = _pow(len(hashes) + 1)[: len(hashes)]
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power, out=total[1:])
    inverse = pow(int(_BASE), -1, 1 << 64)
    steps = np.full(n, inverse, dtype=np.uint64)
    steps[0] = 1
    return mix64((total[width:] - total[:-width]) * np.cumprod(steps, dtype=np.uint64))


def shingle_sets(words: Words, hashes: np.ndarray, width: int = 5):
    """Per document its sorted distinct shingle hashes, flat: (values, counts).

    A document of fewer words has its whole sequence as one shingle; one
    without words has none.
    """
    counts, starts = words.counts, words.first_word[:-1]
    rolled = rolling(hashes, width)
    n_sh = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(words.n_docs), n_sh)
    begin = np.cumsum(n_sh) - n_sh
    at = np.arange(int(n_sh.sum())) - np.repeat(begin, n_sh) + np.repeat(starts, n_sh)
    short = counts < width
    if short.any():
        values = np.zeros(len(at), np.uint64)
        long_rows = ~short[doc]
        values[long_rows] = rolled[at[long_rows]]
        for k in np.flatnonzero(short & (counts > 0)):
            own = hashes[starts[k] : starts[k] + counts[k]]
            values[begin[k]] = mix64(rolling(own, len(own)) + np.uint64(len(own)))[0]
    else:
        values = rolled[at]
    order = np.lexsort((values, doc)) if len(values) < 4096 else _sort_within(values, doc, begin, n_sh)
    values, doc = values[order] if order is not None else values, doc
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    return values[keep], np.bincount(doc[keep], minlength=words.n_docs)


def set_hashes(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of each document's set of shingles, of flat values and counts; the order doesn't matter."""
    total, full = np.zeros(len(counts), np.uint64), counts > 0
    if full.any():
        begin = (np.cumsum(counts) - counts)[full]
        total[full] = np.add.reduceat(mix64(values ^ np.uint64(0x5851F42D4C957F2D)), begin)
    return mix64(total + counts.astype(np.uint64)).view(np.int64)


def _sort_within(values, doc, begin, n_sh):
    """Sorts each document's slice in place."""
    for b, n in zip(begin.tolist(), n_sh.tolist()):
        if n > 1:
            values[b : b + n].sort()
    return None
