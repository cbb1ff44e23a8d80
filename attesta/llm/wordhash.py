"""Words of whole texts as 64-bit hashes, a slice of rows at a time and without a Python object per word.

Texts come as UTF-8; words are runs of bytes other than ASCII blanks, A-Z count as a-z.  A word's hash is a polynomial
of its bytes modulo 2^64, taken from running sums, then mixed.  Two words of a corpus with a billion different ones
share a hash with a probability of a few per cent, so equal hashes are taken for equal words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = 2**20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = np.arange(1, 257, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    return h * np.uint64(0xC2B2AE3D27D4EB4F)


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in order."""
    return mix(a * np.uint64(0x9FB21C651E98DF25) + (b ^ np.uint64(0x2545F4914F6CDD1D)))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * BLOCK)
        base, inverse = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        base[0] = inverse[0] = 1
        _powers[:] = [np.multiply.accumulate(base), np.multiply.accumulate(inverse)]
    return _powers[0], _powers[1]


def _block(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start places of the words of ``data``; a word also ends at each of ``breaks``."""
    inside = ~_BLANK[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    starts[breaks] = inside[breaks]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    earlier = breaks[breaks > 0] - 1
    ends[earlier] = inside[earlier]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends)
    power, inverse = _power_table(len(data))
    sums = (_VALUE[data] * power[:len(data)]).cumsum()
    before = np.where(first > 0, sums[first - 1], np.uint64(0))
    return mix((sums[last] - before) * inverse[first] + (last - first + 1).astype(np.uint64)), first


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string or binary column, row after row, and the number of words up to and with each
    row.  A missing value has no words.  Long rows are taken in blocks that end at a blank."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    missing = column.is_null().to_numpy(zero_copy_only=False)
    if missing.any():
        present = [data[lo:hi] for lo, hi, gone in zip(ends, ends[1:], missing) if not gone]
        data = np.concatenate(present) if present else np.zeros(0, np.uint8)
        ends = np.concatenate([[0], np.where(missing, 0, np.diff(ends)).cumsum()])
    lo, stop = int(ends[0]), int(ends[-1])
    hashes, places = [], []
    while lo < stop:
        hi = min(lo + BLOCK, stop)
        # on to the next blank or row end, so that no word is cut
        row_end = int(ends[np.searchsorted(ends, hi)])
        while hi < row_end and not _BLANK[data[hi]]:
            blank = np.flatnonzero(_BLANK[data[hi:min(hi + BLOCK, row_end)]])
            hi = hi + int(blank[0]) if len(blank) else min(hi + BLOCK, row_end)
        inner = ends[np.searchsorted(ends, lo):np.searchsorted(ends, hi)] - lo
        h, at = _block(data[lo:hi], np.unique(np.append(inner, 0)).astype(np.int64))
        hashes.append(h)
        places.append(at + lo)
        lo = hi
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(column), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), ends[1:])


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` hashes, by doubling: a run is the join of two runs half as long."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, done, power, width = None, 0, h, 1
    while True:
        if n & width:
            part = power[done:done + len(h) - n + 1]
            out = part if out is None else join(out, part)
            done += width
        if 2 * width > n:
            return out
        power = join(power[:-width], power[width:])
        width *= 2
