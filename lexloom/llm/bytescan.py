"""Vectorised scanning of Arrow string columns: words, lines and hashes by numpy over the raw UTF-8 bytes.

A word is a run of bytes other than U+0020 and U+0009 to U+000D, which is ``[^\\x20\\x09-\\x0D]+`` of the text,
as these white-space characters are single bytes of UTF-8.
Texts are taken in slices of about ``SLICE`` bytes so that the temporary arrays stay bounded; one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM = np.random.default_rng(20240607).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    size = 1 << 19
    while size < n:
        size *= 2
    return _powers(size)


def columns(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string or binary column; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if len(col) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(col: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive rows of at most ``most`` bytes, or one longer row."""
    data, offsets = columns(col)
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, none of which crosses a row's border."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    border = offsets[1:-1]
    border = border[border < n]
    first[border] |= inside[border]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = offsets[1:-1]
    before = before[(before > 0) & (before <= n)] - 1
    last[before] |= inside[before]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return runs(~SPACE[data], offsets)


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums for ``span_hash``, one longer than the data."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_RANDOM[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(pre: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans' bytes: equal bytes give equal hashes wherever they stand."""
    _, down = powers(len(pre))
    return mix((pre[ends] - pre[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def row_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row number of each span; empty rows own none."""
    return np.searchsorted(offsets, starts, "right") - 1


def counts(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Spans in each row."""
    return np.diff(np.searchsorted(starts, offsets, "left"))


def shingles(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of one row, and the positions of their first words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(rows[:n] == rows[k - 1 :])
    out = hashes[at].copy()
    for j in range(1, k):
        out *= _STEP
        out += hashes[at + j]
    return mix(out), at


def per_row_sum(values: np.ndarray, n_per_row: np.ndarray) -> np.ndarray:
    """Sums over consecutive runs of the given lengths; 0 for empty runs."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind in "uf" else np.int64)
    np.cumsum(values, out=total[1:])
    ends = np.cumsum(n_per_row)
    return total[ends] - total[ends - n_per_row]


# kinds of bytes for lexemes: 0 white space, 1 letters and digits (all bytes above ASCII too), 2 other signs
KIND = np.full(256, 2, np.uint8)
KIND[SPACE] = 0
KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1


def lexemes(data: np.ndarray, offsets: np.ndarray, signs: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes, capitals): runs of letters and digits and, if wanted, runs of other signs.

    Hashes are of the bytes with A-Z in lower case; capitals marks words of two or more letters, all of A-Z.
    """
    kind = KIND[data]
    starts, ends = runs(kind == 1, offsets)
    upper = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_UPPER[data], out=upper[1:])
    caps = (ends - starts > 1) & (upper[ends] - upper[starts] == ends - starts)
    if signs:
        s, e = runs(kind == 2, offsets)
        order = np.argsort(np.concatenate([starts, s]), kind="stable")
        starts, ends, caps = np.concatenate([starts, s])[order], np.concatenate([ends, e])[order], np.concatenate([caps, np.zeros(len(s), bool)])[order]
    return starts, ends, span_hash(prefix(LOWER[data]), starts, ends), caps


def add_rows(values: np.ndarray, n_per_row: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows of a matrix; zeros for empty runs."""
    out = np.zeros((len(n_per_row), values.shape[1]), values.dtype)
    full = np.flatnonzero(n_per_row)
    if len(full):
        out[full] = np.add.reduceat(values, (np.cumsum(n_per_row) - n_per_row)[full], axis=0)
    return out
