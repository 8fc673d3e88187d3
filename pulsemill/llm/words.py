"""Words of whole Arrow batches: byte spans and 64-bit hashes, found by numpy passes.

A batch is cut into slices of about ``SLICE`` bytes of text, whole documents each, so that
a task's memory is bounded by the slice or by its longest document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pulsemill.functions.batches import tidy  # noqa: F401 - for the operators

SLICE = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)

#: bytes that belong to a word: everything but space and the controls 9 to 13
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: after lower-casing: digits, a-z and whatever is not ASCII
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    """1, b, b^2, ... modulo 2^64 for the base or for its inverse."""
    if len(_powers[which]) < n:
        base = _ODD if which == "up" else _INVERSE
        steps = np.full(max(n, SLICE), base, np.uint64)
        steps[0] = 1
        _powers[which] = np.cumprod(steps, dtype=np.uint64)
    return _powers[which][:n]


@dataclass
class Words:
    """Words of the documents of a slice, in order."""

    data: np.ndarray  # the bytes of all texts, as given
    bounds: np.ndarray  # byte offset of each document, and the end
    start: np.ndarray  # byte offsets of the words
    end: np.ndarray
    first: np.ndarray  # index of each document's first word, and the end
    hash: np.ndarray
    total: np.ndarray  # running sums from which the hash of any run of bytes follows

    def prefix(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first ``n`` bytes of the words that are longer, and these words' places."""
        at = np.flatnonzero(self.end - self.start > n)
        start = self.start[at]
        spread = (self.total[start + n] - self.total[start]) * _power("down", len(self.data) + 1)[start]
        return mix(spread ^ mix(np.full(len(at), n + (1 << 32), np.uint64))), at

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of runs of bytes, as those of words."""
        spread = (self.total[end] - self.total[start]) * _power("down", len(self.data) + 1)[start]
        return mix(spread ^ mix((end - start).astype(np.uint64)))

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        """For each word the document it stands in."""
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def text(self, i: int, j: int) -> bytes:
        """Bytes from word ``i`` to the end of word ``j - 1``, with what stands between."""
        return self.data[self.start[i] : self.end[j - 1]].tobytes()

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offset; a null is an empty text."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if len(texts) == 0 or texts.buffers()[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def find(texts: pa.Array, table: np.ndarray = NOT_SPACE, fold: np.ndarray = SAME) -> Words:
    """Words are the longest runs of bytes in ``table``, after ``fold`` was applied to each byte."""
    data, bounds = raw(texts)
    n = len(data)
    folded = data if fold is SAME else fold[data]
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = table[folded]
    cut = np.zeros(n + 1, bool)  # a document starts here
    cut[bounds] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((folded.astype(np.uint64) + np.uint64(1)) * _power("up", n), out=total[1:])
    spread = (total[end] - total[start]) * _power("down", n + 1)[start]
    first = np.searchsorted(start, bounds)
    return Words(data, bounds, start, end, first, mix(spread ^ mix((end - start).astype(np.uint64))), total)


def grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, and which of them lie in one document."""
    m = len(words.hash) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    found = words.hash[:m].copy()
    for j in range(1, k):
        found = found * _STEP + words.hash[j : m + j]
    last = words.first[1:][words.doc[:m]]
    return mix(found), np.arange(m) + k <= last


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has about ``size`` bytes of text, or one longer document."""
    for batch in batches:
        bounds = raw(batch.column(column))[1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """A list column with ``counts`` of the values in each row."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), values)


def as_long(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit values as Spark's signed ones."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))
