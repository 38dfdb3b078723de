"""Vectorised words, word hashes and shingles over Arrow string columns.

A word is a maximal run of bytes outside [\\x20\\x09-\\x0D]; A-Z may be lower-cased. Hashes are 64-bit: a polynomial
over the bytes modulo 2**64, read from prefix sums, then mixed. Work is cut into blocks of a few MB of whole documents,
and inside a long document into segments for hashing. A text is whole in memory, as Arrow hands it over: memory follows the longest
text (some 30 bytes a byte of it for words and shingles), not the number of texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

BLOCK = 1 << 22
SEGMENT = 1 << 20
U = np.uint64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        n = max(n, SEGMENT + 4096)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, U(base), U)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=U)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def cut(batch: pa.RecordBatch, column: str, limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with at most limit bytes of text each, or one row."""
    ends = np.cumsum(pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and the len+1 bounds of each; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, buf = texts.buffers()
    if off is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


class Words:
    """data: bytes; starts, ends: of each word; first: index of each document's first word, len+1 long."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        data, bounds = raw(texts)
        self.data = _LOWER[data] if lower else data
        self.bounds = bounds
        n = len(data)
        inside = np.zeros(n + 1, bool)
        np.logical_not(_SPACE[data], out=inside[:n])
        head = np.zeros(n + 1, bool)
        head[bounds[:-1]] = True
        head[0] = head[n] = True
        start = inside[:n] & head[:n]
        if n:
            start[1:] |= inside[1:n] & ~inside[: n - 1]
        stop = inside[:n] & head[1:]
        stop |= inside[:n] & ~inside[1:]
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.starts, bounds)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for sorted starts, segment by segment."""
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + SEGMENT)))
        a, b = int(starts[i]), int(ends[i:j].max())
        power, inverse = _powers(b - a + 1)
        sums = np.zeros(b - a + 1, U)
        np.cumsum((data[a:b].astype(U) + U(1)) * power[: b - a], out=sums[1:])
        s = starts[i:j] - a
        out[i:j] = (sums[ends[i:j] - a] - sums[s]) * inverse[s]
        i = j
    return mix(out)


def shingles(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the width-word shingles in order, and the index of each document's first one (len+1).

    A document of fewer words has its whole sequence as its one shingle; one without words has none."""
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(begin[-1], U)
    at = np.repeat(first[:-1] - begin[:-1], count) + np.arange(begin[-1])
    full = np.repeat(n >= width, count)
    if full.any():
        k = at[full]
        s = h[k].copy()
        for i in range(1, width):
            s *= U(0xD6E8FEB86659FD93)
            s += h[k + i]
        out[full] = mix(s)
    for d in np.flatnonzero((n > 0) & (n < width)):
        s = U(len(h[first[d] : first[d + 1]]))
        with np.errstate(over="ignore"):
            for x in h[first[d] : first[d + 1]]:
                s = s * U(0xD6E8FEB86659FD93) + x
        out[begin[d]] = mix(np.array([s ^ U(0x5851F42D4C957F2D)], U))[0]
    return out, begin


def trim() -> None:
    """Give freed memory back to the system, so that a worker that waits for its next task is small again."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(run: Callable) -> Callable:
    """run (batches to batches), with trim() behind its last batch."""

    @wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
