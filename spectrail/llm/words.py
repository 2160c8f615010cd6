"""Words of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_rng = np.random.default_rng(20240607)
#: A random odd-free value for each byte, A-Z as a-z.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 .. n - 1, modulo 2**64."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        with np.errstate(over="ignore"):
            out = []
            for base in (_BASE, _INVERSE):
                x = np.full(size, base, _U)
                x[0] = 1
                out.append(np.multiply.accumulate(x))
        _powers.clear()
        _powers[size] = (out[0], out[1])
    return _powers[size]


def mixed(x: np.ndarray) -> np.ndarray:
    """A good 64-bit hash of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def slices(texts: pa.Array, most: int = 1_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, their bytes, offsets of the rows in them); nulls are empty. About ``most`` bytes each, whole texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        to = max(row + 1, int(np.searchsorted(ends, ends[row] + most, "right")) - 1)
        to = min(to, len(texts))
        yield row, to, data[ends[row] : ends[to]], ends[row : to + 1] - ends[row]
        row = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after the last, and row of each word."""
    inside = ~_SPACE[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    edges = offsets[1:-1]
    before[edges[edges < len(data)]] = False
    after[edges[edges > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of byte spans; with ``lower``, A-Z count as a-z."""
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, _U)
        np.cumsum((_LOWER if lower else _BYTE)[data] * up[: len(data)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


_STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) | _U(1)


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct shingle of ``k`` words, ordered by both; of fewer words, the whole sequence is one."""
    counts = np.bincount(rows, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    with np.errstate(over="ignore"):
        whole = len(hashes) - k + 1
        if whole > 0:
            total = np.zeros(whole, _U)
            for j in range(k):
                total += hashes[j : j + whole] * _STEP[j]
            full = rows[:whole] == rows[k - 1 :]
            row, value = rows[:whole][full], mixed(total[full])
        else:
            row, value = np.zeros(0, np.int64), np.zeros(0, _U)
        few = np.flatnonzero((counts > 0) & (counts < k))
        short = np.full(len(few), 0x5851F42D4C957F2D, _U)
        for j in range(k - 1):
            has = counts[few] > j
            short[has] += (hashes[first[few[has]] + j] + _U(j + 1)) * _STEP[j]
        row, value = np.concatenate([row, few]), np.concatenate([value, mixed(short)])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]
