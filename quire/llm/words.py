"""Words and word shingles of Arrow text columns as numpy arrays, without a Python object per word.

A word is a run of bytes other than space and 0x09-0x0D, in whole texts; a null text has none. Hashes are
64-bit polynomial sums over the bytes, mixed once more, so equal words hash equally in every task.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20  # text handled at once; a longer single text is handled whole

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER_TABLE = np.arange(256, dtype=np.uint8)
LOWER_TABLE[ord("A"):ord("Z") + 1] += 32
LOWER_BYTES = LOWER_TABLE.tobytes()

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, np.ndarray] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def power(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2^64 for ``i`` in ``range(n)``."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, CHUNK_BYTES), base, dtype=np.uint64)
        out[0] = 1
        out = np.multiply.accumulate(out)
        if n > 4 * CHUNK_BYTES:  # a very long text: do not keep its table
            return out[:n]
        _powers[base] = have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most ``size`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = _offsets(batch.column(text))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, after the last of which a worker hands what it has freed, and the tables of powers, back to the system.

    Spark keeps its workers for later tasks, and what they hold meanwhile counts beside the executor's heap.
    """
    yield from batches
    _powers.clear()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def _offsets(col: pa.Array) -> np.ndarray:
    return np.frombuffer(col.buffers()[1], dtype=np.int32, count=len(col) + 1, offset=4 * col.offset).astype(np.int64)


def text_bytes(col: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text. ``lower`` lower-cases A-Z only."""
    if col.null_count:
        col = col.fill_null("")
    offsets = _offsets(col)
    data = col.buffers()[2]
    if data is None:
        return np.zeros(0, dtype=np.uint8), offsets - offsets[0]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]]
    return (LOWER_TABLE[data] if lower else data), offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray, parting: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte bounds of the words, and the index of each document's first word (one more at the end)."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    solid = ~parting[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | cut[1:-1]
    finish = solid.copy()
    finish[:-1] &= ~solid[1:] | cut[1:-1]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(finish) + 1, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash per word."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    total = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power(_BASE, len(data)))
    before = np.where(start > 0, total[start - 1], np.uint64(0))
    return mix((total[end - 1] - before) * power(_BASE_INVERSE, len(data))[start])


def run_hashes(hashes: np.ndarray, k: int, step: np.uint64 = _STEP) -> np.ndarray:
    """A hash for every run of ``k`` entries (also across documents), ``len - k + 1`` of them."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= step
        out += hashes[j:j + n]
    return mix(out ^ np.uint64(k))


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds): the ``k``-word shingles of each document, repeats included.

    A document of fewer words has its whole sequence as the only shingle, an empty one has none.
    """
    words = np.diff(first)
    counts = np.where(words >= k, words - k + 1, (words > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    values = np.zeros(bounds[-1], dtype=np.uint64)
    doc = np.repeat(np.arange(len(words)), words)
    runs = run_hashes(hashes, k)
    at = np.arange(len(runs))
    at = at[at + k <= first[doc[:len(runs)] + 1]]
    values[bounds[doc[at]] + at - first[doc[at]]] = runs[at]
    for m in range(1, k):
        short = np.flatnonzero(words == m)
        if len(short):
            values[bounds[short]] = run_hashes(hashes, m)[first[short]]
    return values, bounds
