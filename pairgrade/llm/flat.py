"""Texts of an Arrow batch as one flat array of UTF-8 bytes.

Tasks work on whole columns of bytes with numpy instead of on Python strings.
A null text counts as an empty one.  `chunks` keeps the arrays small: about
`CHUNK` bytes at a time, or one text where a text is longer than that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20

# Fixed: white space that separates words, U+0020 and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and the n + 1 offsets of the texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, at, held = column.buffers()
    off = np.frombuffer(at, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole texts."""
    data, off = utf8(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, side="right")) - 1)
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of `inside` that do not cross texts: starts, ends, and n + 1 offsets into them."""
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    full = off[:-1][off[:-1] < off[1:]]
    before[full] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(inside), bool)
    after[:-1] = inside[1:]
    after[off[1:][off[:-1] < off[1:]] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, off)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+`: starts, ends and the offsets of each text's words."""
    return spans(~SPACE[data], off)


def per_text(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of `values` (one row per byte or word) over each text; 0 for an empty text."""
    total = np.zeros((len(off), *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(off[:-1] < off[1:])
    if len(full):
        total[full] = np.add.reduceat(values, off[:-1][full], axis=0, dtype=total.dtype)
    return total[:-1]


def code_points(data: np.ndarray) -> np.ndarray:
    """True at the first byte of each code point."""
    return (data & 0xC0) != 0x80


_M = np.uint64(0x9E3779B97F4A7C15)
_N = np.uint64(0xBF58476D1CE4E5B9)
_P = 0x5851F42D4C957F2D
_INVERSE = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _N
    x = (x ^ (x >> np.uint64(27))) * _M
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _M)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; equal ranges have equal hashes wherever they lie."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_P, n), out=total[1:])
    return mix((total[end] - total[start]) * _powers(_INVERSE, n + 1)[start] + (end - start).astype(np.uint64) * _M)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
