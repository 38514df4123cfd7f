"""Vectorised views of Arrow text columns: words, lines and their 64-bit hashes.

Every function works on one Arrow batch cut into blocks of bounded size, so memory follows
the block and the longest single text, never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that separate words: the class [\x20\x09-\x0D].
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
BLOCK_BYTES = 1 << 20
#: Bytes that are hashed together.
HASHED_BYTES = 1 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True

_U = np.uint64
_SPAN = 1 << 16


def _randoms(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, n, dtype=np.uint64) * _U(2) + _U(1)


BYTE_KEYS = _randoms(11, 256)
LOWER_KEYS = BYTE_KEYS.copy()
LOWER_KEYS[65:91] = BYTE_KEYS[97:123]
_NEAR, _FAR = _randoms(12, _SPAN), _randoms(13, _SPAN)
_FAR[0] = 1  # a short range has the same hash beside a long one as without


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit integers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def blocks(texts: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about `limit` bytes; a null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, len(texts))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of non-space bytes; runs end with their text."""
    ink = ~IS_SPACE[data]
    before = np.empty_like(ink)
    before[1:], before[:1] = ink[:-1], False
    after = np.empty_like(ink)
    after[:-1], after[-1:] = ink[1:], False
    edges = offsets[1:-1]
    before[edges[edges < len(data)]] = False
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(ink & ~before)
    ends = np.flatnonzero(ink & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray = BYTE_KEYS) -> np.ndarray:
    """A 64-bit multilinear hash of each byte range; ranges are in order and don't overlap, gaps are free.

    Ranges are taken together up to HASHED_BYTES at a time, so a very long text needs no more memory than that
    beside its own bytes and ranges.
    """
    total = np.cumsum(ends - starts)
    if len(starts) < 2 or total[-1] <= HASHED_BYTES:
        return _hashes(data, starts, ends, keys)
    cuts = np.flatnonzero(np.diff(total // HASHED_BYTES)) + 1
    edges = [0, *cuts.tolist(), len(starts)]
    return np.concatenate([_hashes(data, starts[a:b], ends[a:b], keys) for a, b in zip(edges[:-1], edges[1:], strict=True)])


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    out = mix(lengths.astype(np.uint64))
    if not total:
        return out
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(total)
    place = at - np.repeat(starts, lengths)
    value = keys[data[at]] * _NEAR[place & (_SPAN - 1)]
    if int(lengths.max()) > _SPAN:
        value *= _FAR[(place >> 16) & (_SPAN - 1)]
    full = lengths > 0
    cuts = (np.cumsum(lengths) - lengths)[full]
    out[full] += np.add.reduceat(value, cuts)
    return mix(out)


def count_true(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text the mask holds."""
    full = np.diff(offsets) > 0
    out = np.zeros(len(offsets) - 1, np.int64)
    if full.any():
        out[full] = np.add.reduceat(mask, offsets[:-1][full], dtype=np.int64)
    return out


def windows(hashed: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of `size` neighbours in the same row, and the index where each begins."""
    n = len(hashed) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * _U(0x9E3779B97F4A7C15) + hashed[k : k + n]
    at = np.flatnonzero(rows[:n] == rows[size - 1 :])
    return mix(total[at]), at


def per_row(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Count, or sum of weights, for each of n rows, as int64."""
    return np.bincount(rows, weights, n).astype(np.int64) if len(rows) else np.zeros(n, np.int64)


def code_points(data: np.ndarray) -> np.ndarray:
    """True at the first byte of every code point."""
    return (data & 0xC0) != 0x80
