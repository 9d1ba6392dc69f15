"""Words and word windows of Arrow text columns as 64-bit hashes.

Everything works on the UTF-8 bytes of a slice of rows, with numpy over all rows of the
slice at once. A word is a longest run of bytes that are not separators; A-Z count as a-z.
Hashes depend on the words alone, never on the process, so that any task may meet any
other's. Two different windows share a hash with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

#: Separators of "words between white space" and of "runs of letters and digits".
SPACES = np.array([b in b" \t\n\x0b\x0c\r" for b in range(256)])
NOT_ALNUM = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])

_rng = np.random.Generator(np.random.PCG64(20))
_BYTES = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BYTES[ord("A"):ord("Z") + 1] = _BYTES[ord("a"):ord("z") + 1]
_PLACES = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse, up to n."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, 4096)
        _powers[:] = [
            np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]).cumprod()
            for base in (np.uint64(_BASE), np.uint64(pow(_BASE, -1, 2**64)))
        ]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose outputs look random."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    """Words of consecutive rows; those of row i are first[i]:first[i + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def text(self, i: int, j: int) -> tuple[bytes, ...]:
        """Words i to j - 1 in lower case."""
        return tuple(self.data[self.start[k]:self.end[k]].tobytes().lower() for k in range(i, j))


def plain(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one array without nulls (null: empty), not copied if it is one already."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.cast(pa.large_string()).combine_chunks()
    if not (pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type)):
        texts = texts.cast(pa.large_string())
    return texts.fill_null("") if texts.null_count else texts


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes; a longer row is a range of its own."""
    ends = _offsets(texts)
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(ends, ends[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), len(texts))
        yield lo, hi
        lo = hi
    # A worker lives on after its task; what a batch needed goes back to the system.
    pa.default_memory_pool().release_unused()


def _offsets(texts: pa.Array) -> np.ndarray:
    if not len(texts):
        return np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes, one after the other, and where each starts and the last ends."""
    ends = _offsets(texts)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[ends[0]:ends[-1]] if buffer else np.empty(0, np.uint8)
    return data, ends - ends[0]


def words(texts: pa.Array, separators: np.ndarray) -> Words:
    data, ends = bytes_of(texts)
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return Words(data, none, none, np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64))
    inside = ~separators[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[ends[:-1][ends[:-1] < n]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    cuts = ends[1:][ends[1:] > 0] - 1
    after[cuts] = False
    end = np.flatnonzero(inside & ~after) + 1
    up, down = _tables(n)
    if len(start):
        values = _BYTES[data]
        values[~inside] = 0
        values *= up[:n]
        hashes = mix(np.add.reduceat(values, start) * down[start])
    else:
        hashes = np.empty(0, np.uint64)
    return Words(data, start, end, hashes, np.searchsorted(start, ends))


def stem_hashes(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Words longer than `size` bytes, by number, and the hash of their first `size` bytes."""
    longer = np.flatnonzero(found.end - found.start > size)
    total = np.full(len(longer), size * _BASE % 2**64, np.uint64)
    for i in range(size):
        total += _BYTES[found.data[found.start[longer] + i]] * _PLACES[i]
    return longer, mix(total ^ np.uint64(_BASE))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every `width` consecutive words, across rows too; the width counts."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, width * _BASE % 2**64, np.uint64)
    for k in range(width):
        total += hashes[k:k + n] * _PLACES[k % len(_PLACES)]
    return mix(total)


def whole_hash(hashes: np.ndarray) -> np.uint64:
    """Hash of a sequence shorter than a window, unlike any window's of another width."""
    return window_hashes(hashes, len(hashes))[0]


def shingle_lists(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Per row the window hashes, repeats included; a row of fewer words is one shingle."""
    found = words(texts, SPACES)
    windows = window_hashes(found.hashes, width)
    for lo, hi in zip(found.first[:-1].tolist(), found.first[1:].tolist()):
        if hi - lo >= width:
            yield windows[lo:hi - width + 1]
        elif hi > lo:
            yield np.array([whole_hash(found.hashes[lo:hi])], np.uint64)
        else:
            yield np.empty(0, np.uint64)
