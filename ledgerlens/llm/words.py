"""Words of Arrow text columns as numpy arrays: bounds, 64-bit hashes, rolling hashes.

Tasks work on the UTF-8 bytes of a whole batch at once and make no object per word. Separators
are ASCII, so cutting bytes never cuts a character.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_STEP = 1 << 20  # bytes hashed at once; bounds the scratch arrays, not the text
_BASE = 0x100000001B3
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ROLL = np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# The bytes that belong to words.
SPACED = np.ones(256, dtype=bool)
SPACED[[32, *range(9, 14)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Powers:
    up = _powers(_BASE, _STEP + 4096)
    down = _powers(pow(_BASE, -1, 2**64), _STEP + 4096)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):  # one word longer than a step
            return _powers(_BASE, n), _powers(pow(_BASE, -1, 2**64), n)
        return cls.up[:n], cls.down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all its bits; not linear, so sums of mixed hashes do not cancel."""
    h = h ^ (h >> np.uint64(29))
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows and the row bounds in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; spans are in order and do not overlap."""
    out = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):
        base = int(start[at])
        to = max(at + 1, int(np.searchsorted(end, base + _STEP, side="right")))
        piece = data[base:int(end[to - 1])]
        up, down = _Powers.of(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[piece] * up[:-1], out=sums[1:])
        s, e = start[at:to] - base, end[at:to] - base
        out[at:to] = mix((sums[e] - sums[s]) * down[s])
        at = to
    return out


@dataclass
class Words:
    """Words of a batch: ``first[i]:first[i + 1]`` are the words of row i."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    _hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = span_hashes(self.data, self.start, self.end)
        return self._hash

    def bytes_of(self, word: int) -> bytes:
        return self.data[self.start[word]:self.end[word]].tobytes()

    def joined(self, word: int, count: int) -> bytes:
        return b" ".join(self.bytes_of(i) for i in range(word, word + count))


def words_of(column: pa.Array, kind: np.ndarray = SPACED, lower: bool = False) -> Words:
    data, bounds = text_bytes(column)
    if lower:
        data = _LOWER[data]
    inside = kind[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    full = bounds[:-1] < bounds[1:]
    head, tail = bounds[:-1][full], bounds[1:][full] - 1
    begins[head] = inside[head]
    stops[tail] = inside[tail]
    start = np.flatnonzero(begins)
    return Words(data, start, np.flatnonzero(stops) + 1, np.searchsorted(start, bounds))


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of ``k`` consecutive entries from each position; the last k - 1 have none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _ROLL
        out += hashes[j:j + n]
    return mix(out)


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Positions from which ``k`` words lie in one row."""
    ok = np.ones(max(0, int(first[-1]) - k + 1), dtype=bool)
    for j in range(1, k):  # the last k - 1 words of a row start no window
        late = first[1:] - j
        late = late[(late >= first[:-1]) & (late < len(ok))]
        ok[late] = False
    return np.flatnonzero(ok)


def covered(length: int, starts: np.ndarray, k: int | np.ndarray) -> np.ndarray:
    """Which of ``length`` positions lie in a span of ``k`` from one of ``starts``."""
    steps = np.zeros(length + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + k, -1)
    return np.cumsum(steps[:-1]) > 0


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` (one per word) in each row; empty rows give 0."""
    total = np.zeros(len(values) + 1, dtype=np.int64 if values.dtype == bool else values.dtype)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
