"""Words of whole Arrow string columns as 64-bit hashes, computed with numpy a few megabytes at a time.

A word is a run of digits, ASCII letters and non-ASCII characters, with A-Z lowered. In UTF-8 this
is a class of single bytes, so word borders are found on the raw bytes without decoding them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True

_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64, for at least n positions."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES)
        made = []
        for base in (_MULTIPLIER, _INVERSE):
            column = np.full(size, base, dtype=np.uint64)
            column[0] = 1
            made.append(np.multiply.accumulate(column))
        if size > CHUNK_BYTES:  # one very long text: do not keep its tables
            return made[0], made[1]
        _powers = made[0], made[1]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its n + 1 offsets into them; a null text has no bytes."""
    wide = pa.types.is_large_string(column.type)
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data is not None and len(bounds) and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with at most `most` bytes, or of one longer row."""
    raw, bounds = utf8(column)
    row, n = 0, len(bounds) - 1
    while row < n:
        end = int(np.searchsorted(bounds, bounds[row] + most, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, raw[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]
        row = end


def word_places(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end byte) of each word, and n + 1 offsets into them by row."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    inside = IS_WORD[LOWER[raw]]
    first = np.zeros(n + 1, dtype=bool)
    first[bounds] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, bounds, side="left")


def words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, n + 1 offsets into them by row)."""
    starts, ends, at = word_places(raw, bounds)
    return spans(LOWER[raw], starts, ends), at


def spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each raw[start:end], the same wherever the bytes stand."""
    power, inverse = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of `width` words, with offsets by row; a row of fewer words, but not none, has one of all its words."""
    counts = np.diff(bounds)
    made = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    at = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(made, out=at[1:])
    if not at[-1]:
        return np.zeros(0, np.uint64), at
    starts = np.arange(at[-1]) - np.repeat(at[:-1] - bounds[:-1], made)
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    row_end = np.repeat(bounds[1:], made)
    out = np.zeros(at[-1], np.uint64)
    for k in range(width):
        piece = np.where(starts + k < row_end, padded[starts + k], np.uint64(0))
        out = out * np.uint64(_MULTIPLIER) + piece + np.uint64(k)
    return mix(out), at
