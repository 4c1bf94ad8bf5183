"""Texts of an Arrow batch as arrays: words and their places without a loop over words.

Texts are taken in blocks of about ``BLOCK`` bytes, one text at least, so memory is bounded by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes and texts of a block.
BLOCK, TEXTS = 4 << 20, 4096
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: all but blanks; and digits, small letters and all that is not ASCII.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
LETTERS = np.zeros(256, bool)
LETTERS[0x30:0x3A] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True


class Words(NamedTuple):
    #: The bytes of all words, lower-cased (A-Z only), one after another.
    data: np.ndarray
    #: Where each word begins in ``data``, and the end of the last.
    starts: np.ndarray
    #: The index of each text's first word, and the number of all.
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.diff(self.bounds)

    @property
    def lengths(self) -> np.ndarray:
        """Bytes of each word."""
        return np.diff(self.starts)


def blocks(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Parts of a column of texts with the index of their first; null becomes empty."""
    texts = column.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        stop = int(np.searchsorted(ends, ends[at] + BLOCK, "right")) - 1
        stop = min(max(stop, at + 1), at + TEXTS, len(texts))
        yield at, texts.slice(at, stop - at)
        at = stop


def words(texts: pa.Array, inside: np.ndarray) -> Words:
    """The runs of bytes that ``inside`` marks; no word reaches over the end of its text."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw else np.empty(0, np.uint8)
    ends = ends - ends[0]
    data = LOWER[data]
    within = inside[data]
    first = within.copy()
    first[1:] &= ~within[:-1]
    heads = ends[:-1][ends[:-1] < len(data)]
    first[heads] = within[heads]
    begins = np.flatnonzero(first)
    kept = data[within]
    starts = np.append((np.cumsum(within) - 1)[begins], len(kept))
    return Words(kept, starts, np.searchsorted(begins, ends))


def strings(w: Words) -> pa.Array:
    """The words as an Arrow array, without copies."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(w.starts) - 1, [None, pa.py_buffer(np.ascontiguousarray(w.starts, np.int64)), pa.py_buffer(np.ascontiguousarray(w.data))])


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers with all bits mixed (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of every word: its bytes as coefficients of a polynomial, mixed."""
    lengths = w.lengths
    if not len(lengths):
        return np.empty(0, np.uint64)
    powers = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64))
    place = np.arange(len(w.data)) - np.repeat(w.starts[:-1], lengths)
    summed = np.add.reduceat((w.data.astype(np.uint64) + np.uint64(1)) * powers[place], w.starts[:-1])
    return mixed(summed)


def shingle_hashes(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every ``k``-word shingle; fewer than ``k`` words make one of them all, no words make none."""
    each = hashes(w)
    n, counts = len(each), w.counts
    text = np.repeat(np.arange(len(counts)), counts)
    end = w.bounds[1:][text]
    at = np.arange(n)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        factor = mixed(np.array([j + 1], np.uint64))[0] | np.uint64(1)
        m = max(n - j, 0)
        total[:m] += np.where(at[:m] + j < end[:m], each[j:] * factor, np.uint64(0))
    valid = (at + k <= end) | ((counts[text] < k) & (at == w.bounds[:-1][text]))
    return text[valid], mixed(total[valid])
