"""DartMinHash signatures of weighted sets, for many sets at once.

Every element owns a half-plane of weight and rank in which darts land as a Poisson process of unit
rate that depends only on the element. The weight axis is cut into the regions [0,1), [1,2), [2,4),
[4,8) ...; inside a region darts arrive in order of rank, so they are thrown one by one until the
rank passes the set's limit, and a dart counts if its weight is below the element's. A set of total
weight W with limit t/W keeps about t darts; each falls in one of k coordinates, and the earliest of
a coordinate is its value. Two sets agree in a coordinate with the probability of their weighted
Jaccard similarity. Sets with an empty coordinate throw on to twice the rank.
"""

from __future__ import annotations

import math

import numpy as np

from .textcols import LOWER_KEYS, hashes, mix, per_row, windows, words

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
_STEP = _U(0xD1B54A32D192ED03)
_UNIT = 2.0**-53


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the distinct runs of `size` lower-cased words of each text, sorted by row and hash.

    A text of fewer words is one shorter run; a text without words has none.
    """
    starts, ends, rows = words(data, offsets)
    hashed = hashes(data, starts, ends, LOWER_KEYS)
    n = len(offsets) - 1
    key, at = windows(hashed, rows, size)
    row = rows[at]
    counts = per_row(rows, n)
    for length in range(1, size):
        short, begin = windows(hashed, rows, length)
        chosen = counts[rows[begin]] == length
        key, row = np.concatenate((key, short[chosen] + _U(length))), np.concatenate((row, rows[begin][chosen]))
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    place = np.flatnonzero(first)
    return row[place], key[place], np.diff(np.concatenate((place, [len(key)])))


def text_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's sequence of lower-cased words, and its number of words."""
    starts, ends, rows = words(data, offsets)
    hashed = hashes(data, starts, ends, LOWER_KEYS)
    n = len(offsets) - 1
    counts = per_row(rows, n)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = []
    for salt in (_U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F)):
        spread = mix(hashed * salt + mix(place.astype(np.uint64) + salt))
        total = np.zeros(n, np.uint64)
        full = counts > 0
        if full.any():
            total[full] = np.add.reduceat(spread, (np.cumsum(counts) - counts)[full])
        out.append(mix(total + counts.astype(np.uint64)))
    return out[0], out[1], counts


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> _U(11)).astype(np.float64) + 0.5) * _UNIT


def signatures(row: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int, k: int, seed: int = 1) -> np.ndarray:
    """n x k values (uint32); rows without elements are all zero."""
    out = np.zeros((n, k), np.uint32)
    total = np.bincount(row, weight, n) if len(row) else np.zeros(n)
    todo = np.flatnonzero(total > 0)
    thrown = k * math.log(k) + 2 * k
    while len(todo):
        chosen = np.isin(row, todo) if len(todo) < np.count_nonzero(total) else slice(None)
        filled = _throw(row[chosen], key[chosen], weight[chosen].astype(np.float64), total, n, k, thrown, seed, out)
        todo = todo[~filled[todo]]
        thrown *= 2
    return out


def _throw(row: np.ndarray, key: np.ndarray, weight: np.ndarray, total: np.ndarray, n: int, k: int, thrown: float, seed: int, out: np.ndarray) -> np.ndarray:
    # Elements reach into as many weight regions as begin below their weight: 1 for weight 1, and 1 + ceil(log2 w) beyond.
    reach = np.where(weight <= 1, 1, 1 + np.ceil(np.log2(np.maximum(weight, 1)))).astype(np.int64)
    owner = np.repeat(np.arange(len(row)), reach)
    region = np.arange(len(owner)) - np.repeat(np.cumsum(reach) - reach, reach)
    low = np.where(region == 0, 0.0, np.exp2(region - 1.0))
    width = np.where(region == 0, 1.0, low)
    state = mix(key[owner] + (region.astype(np.uint64) + _U(seed << 8)) * _GOLD)
    limit = thrown / total[row[owner]]
    rank = np.zeros(len(owner))
    alive = np.arange(len(owner))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    throw = 0
    while len(alive):
        throw += 1
        dart = mix(state[alive] + _U(throw * int(_STEP) % 2**64))
        rank[alive] -= np.log(_uniform(dart)) / width[alive]
        alive_now = rank[alive] < limit[alive]
        alive, dart = alive[alive_now], dart[alive_now]
        name = mix(dart + _GOLD)
        inside = low[alive] + width[alive] * _uniform(mix(dart ^ _STEP)) < weight[owner[alive]]
        found.append((row[owner[alive[inside]]], name[inside], rank[alive[inside]]))
    rows, names, ranks = (np.concatenate(x) for x in zip(*found, strict=True))
    cell = rows * k + ((names >> _U(32)) % _U(k)).astype(np.int64)
    late_first = np.argsort(-ranks, kind="stable")
    flat = out.reshape(-1)
    cell = cell[late_first]
    hit = np.zeros(n * k, bool)
    flat[cell] = (names[late_first] & _U(0xFFFFFFFF)).astype(np.uint32)
    hit[cell] = True
    return hit.reshape(n, k).all(axis=1)


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """n x bands 64-bit keys; a key also depends on its band's number."""
    n, k = signature.shape
    parts = signature.reshape(n, bands, k // bands).astype(np.uint64)
    key = np.tile(mix(np.arange(bands, dtype=np.uint64) + _GOLD), (n, 1))
    for i in range(k // bands):
        key = mix(key + parts[:, :, i] * _STEP)
    return key


def similarity(data_a, offsets_a, data_b, offsets_b, size: int = 5) -> np.ndarray:
    """Weighted Jaccard similarity (sum of least over sum of greatest counts) of row i of a with row i of b."""
    n = len(offsets_a) - 1
    ra, ka, ca = shingles(data_a, offsets_a, size)
    rb, kb, cb = shingles(data_b, offsets_b, size)
    row, key, count = np.concatenate((ra, rb)), np.concatenate((ka, kb)), np.concatenate((ca, -cb))
    total = np.bincount(ra, ca, n) + np.bincount(rb, cb, n)
    order = np.lexsort((key, row))
    row, key, count = row[order], key[order], count[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    place = np.flatnonzero(first)
    gap = np.bincount(row[place], np.abs(np.add.reduceat(count, place)), n) if len(place) else np.zeros(n)
    return np.where(total > 0, (total - gap) / np.maximum(total + gap, 1), 0.0)
