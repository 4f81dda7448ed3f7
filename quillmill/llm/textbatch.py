"""Vectorised word handling for Arrow string batches: numpy over the raw UTF-8 bytes, no per-word Python.

A word is a run of bytes without ASCII white space.  Word hashes are prefix-sum polynomial hashes modulo
2**64 passed through a 64-bit finaliser, so equal words have equal hashes in every task of every job.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are handled in slices of about so many bytes, which bounds a worker's memory; one longer text is a slice of its own.
SLICE_BYTES = 1_000_000

_WS = np.zeros(256, dtype=bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
#: For plain words: everything in ASCII but letters and digits separates.
_PLAIN = np.ones(256, dtype=bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: For words and punctuation: white space 0, plain words 1, runs of punctuation 2.
_KIND = np.where(_WS, 0, np.where(_PLAIN, 2, 1)).astype(np.uint8)

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads a uint64 over all its bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + 1024)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


class SegmentHash:
    """Order-sensitive hashes of segments of values; they depend on a segment's values alone."""

    def __init__(self, values: np.ndarray):
        up, self._down = _pow(len(values) + 1)
        self._p = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=self._p[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._p[ends] - self._p[starts]) * self._down[starts] + (ends - starts).astype(np.uint64))


def segment_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end] for each segment."""
    return SegmentHash(values)(starts, ends)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its texts; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if buffers[2] is None or not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def give_back() -> None:
    """Freed memory goes back to the system: a worker that is done waits beside those that work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(column: pa.Array, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """(first row, last row + 1) of consecutive slices with about SLICE_BYTES of text each."""
    limit = limit or SLICE_BYTES
    _, offsets = text_bytes(column)
    at, n = 0, len(column)
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


class Words:
    """The words of some texts: where each begins and ends, its hash, and the texts' ranges of words.

    plain: words are runs of letters, digits and non-ASCII bytes, and the hashes ignore the case of Latin letters;
    with punct too, runs of punctuation are words as well.
    """

    def __init__(self, column: pa.Array, plain: bool = False, punct: bool = False):
        self.data, self.offsets = text_bytes(column)
        data, n = self.data, len(self.data)
        self.n_docs = len(self.offsets) - 1
        if n:
            kind = _KIND[data] if punct else ~(_PLAIN if plain else _WS)[data]
            turn = np.ones(n + 1, dtype=bool)
            np.not_equal(kind[1:], kind[:-1], out=turn[1:-1])
            turn[self.offsets] = True
            solid = kind > 0
            self.starts = np.flatnonzero(solid & turn[:-1])
            self.ends = np.flatnonzero(solid & turn[1:]) + 1
        else:
            self.starts = self.ends = np.zeros(0, dtype=np.int64)
        #: words of text i: bounds[i] .. bounds[i + 1]
        self.bounds = np.searchsorted(self.starts, self.offsets)
        if plain and n:
            upper = (data >= 65) & (data <= 90)
            upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
            data = data + upper.astype(np.uint8) * np.uint8(32)
        self.hash = segment_hash(data, self.starts, self.ends) if n else np.zeros(0, dtype=np.uint64)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), np.diff(self.bounds))

    def chars(self) -> np.ndarray:
        """Code points in each word."""
        if not len(self.data):
            return np.zeros(0, dtype=np.int64)
        p = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=p[1:])
        return p[self.ends] - p[self.starts]

    def lines(self) -> np.ndarray:
        """For each word a number that is the same for the words of one line of one text, and grows."""
        if not len(self.data):
            return np.zeros(0, dtype=np.int64)
        return np.cumsum(self.data == 10)[self.starts] + self.doc


def doc_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]]; empty ranges give 0."""
    p = np.zeros(len(values) + 1, dtype=np.int64 if values.dtype.kind in "biu" else np.float64)
    np.cumsum(values, out=p[1:])
    return p[bounds[1:]] - p[bounds[:-1]]
