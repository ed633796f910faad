"""Vectorised word and shingle hashing over Arrow string columns.

Works on the UTF-8 buffers directly, so no Python string is made. A word is a
maximal run of bytes other than space and the controls 0x09-0x0D; both are
ASCII, so byte runs and character runs are the same words. Hashes are 64 bits:
a polynomial over per-byte random values, finished by a mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64), a bijection."""
    with np.errstate(over="ignore"):
        x = x + U64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(256, dtype=U64) + U64(1))
_BASE = 0x9E3779B97F4A7C15 | 1
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if "pow" not in _powers or len(_powers["pow"]) < n:
        size = max(n, CHUNK_BYTES + 1024)
        for name, base in (("pow", _BASE), ("inv", pow(_BASE, -1, 1 << 64))):
            out = np.ones(size, U64)
            with np.errstate(over="ignore"):
                out[1:] = U64(base)
                np.multiply.accumulate(out, out=out)
            _powers[name] = out
    return _powers["pow"], _powers["inv"]


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; a null is an empty string."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    if len(col) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64, len(col) + 1, col.offset * 8)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], body[offsets[0] : offsets[-1]]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def word_hashes(offsets: np.ndarray, body: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words up to each row boundary)."""
    if len(body) == 0:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    word = ~_SEP[body]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    inner = offsets[:-1][offsets[:-1] < len(body)]
    before[inner] = False
    starts = np.flatnonzero(word & ~before)
    if len(starts) == 0:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    pw, inv = _power_tables(len(body))
    with np.errstate(over="ignore"):
        value = _BYTE[_LOWER[body] if lower else body] * pw[: len(body)]
        value[~word] = 0
        hashes = np.add.reduceat(value, starts) * inv[starts]
    return mix(hashes), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `width` words in a row, and bounds by row; a row with fewer
    words has its whole sequence as one, a row without words none."""
    counts = np.diff(bounds)
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(n)), n)
    first = bounds[:-1][row] + np.arange(out_bounds[-1]) - out_bounds[:-1][row]
    length = np.minimum(counts[row], width)
    h = mix(length.astype(U64))
    with np.errstate(over="ignore"):
        for k in range(width):
            on = length > k
            h[on] = mix(h[on] * U64(3) + words[first[on] + k])
    return h, out_bounds
