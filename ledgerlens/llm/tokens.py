"""Token ids of text columns with the tokenizers library, each distinct word encoded once a batch.

A single blank or line end between two plain characters, and the change between a letter and a
punctuation mark other than the apostrophe, are always borders of the tokenizers' own pieces, and
merges never cross them. Texts are therefore cut there, each distinct stretch of a batch is encoded
once, and ids are put together again; ``tests/llm`` compare this with encoding whole texts. A
worker remembers stretches, up to a limit, from one batch to the next.
Strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from ledgerlens.llm.words import span_hashes, text_bytes

_SLICE = 4 << 20  # bytes of text encoded at once

# Bytes of plain characters, which are visible ASCII and U+00C0 to U+017F. All of
# the latter are letters but U+00D7 and U+00F7 (C3 97 and C3 B7); U+0130 (C4 B0) ends in a mark
# once it is in lower case, so it does not count as one.
_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[0x21:0x7F] = True
_LEAD = np.zeros(256, dtype=bool)
_LEAD[0xC3:0xC6] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = _PLAIN & ~_LETTER
_MARK[[*range(0x30, 0x3A), 0x27]] = False
_NO_LETTERS = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0))


@lru_cache(maxsize=2)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


@dataclass
class Ids:
    """Ids of a batch: ``first[i]:first[i + 1]`` are those of row i."""

    ids: np.ndarray
    first: np.ndarray

    def row(self, i: int) -> np.ndarray:
        return self.ids[self.first[i]:self.first[i + 1]]


def _stretches(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the stretches, and for each row its first stretch."""
    n = len(data)
    border = np.zeros(n, dtype=bool)
    if n > 2:
        lead = _LEAD[data]
        before, after = data[:-1], data[1:]
        sign = np.logical_or.reduce([(before == a) & (after == b) for a, b in _NO_LETTERS])
        plain_end, plain_start = _PLAIN[data], _PLAIN[data] | lead
        plain_end[1:] |= lead[:-1]
        letter_end, letter_start = _LETTER[data], _LETTER[data] | lead
        letter_end[1:] |= lead[:-1] & ~sign
        letter_start[:-1] &= ~sign
        mark = _MARK[data]
        between = plain_end[:-2] & plain_start[2:]
        line = (data[1:-1] == 10) & between
        border[1:-1] = ((data[1:-1] == 32) & between) | line
        border[2:] |= line
        border[1:] |= (mark[1:] & letter_end[:-1]) | (letter_start[1:] & mark[:-1])
    full = bounds[:-1] < bounds[1:]
    inner = bounds[:-1][full]
    border[inner] = True
    last = bounds[1:][full] - 1  # a blank or line end that ends a row has its neighbour in another row
    last = last[(last > inner) & ((data[last] == 32) | (data[last] == 10))]
    border[last] = False
    start = np.flatnonzero(border)
    return start, np.searchsorted(start, bounds)


def encode(column: pa.Array, path: str, end_id: int) -> Ids:
    """Ids of every text with ``end_id`` after each; null counts as empty."""
    data, bounds = text_bytes(column)
    parts, counts = [], []
    row = 0
    while row < len(bounds) - 1:
        to = max(row + 1, int(np.searchsorted(bounds, bounds[row] + _SLICE, side="right")) - 1)
        here = bounds[row:to + 1] - bounds[row]
        ids, first = _encode_slice(data[bounds[row]:bounds[to]], here, path)
        size = np.diff(first)
        out = np.full(len(ids) + len(size), end_id, dtype=np.uint32)
        place = np.arange(len(ids)) + np.repeat(np.arange(len(size)), size)
        out[place] = ids
        parts.append(out)
        counts.append(size + 1)
        row = to
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    return Ids(ids, np.concatenate(([0], np.cumsum(np.concatenate(counts) if counts else []))).astype(np.int64))


class _Known:
    """Ids of stretches seen by this worker, by hash; emptied when ``LIMIT`` is passed."""

    LIMIT = 600_000

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where unknown."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def add(self, hashes: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        begin = len(self.flat) + np.cumsum(size) - size
        every = np.concatenate((self.hashes, hashes))
        order = np.argsort(every, kind="stable")
        self.hashes = every[order]
        self.begin = np.concatenate((self.begin, begin))[order]
        self.size = np.concatenate((self.size, size))[order]
        self.flat = np.concatenate((self.flat, flat))


@lru_cache(maxsize=2)
def _known(path: str) -> _Known:
    return _Known()


def _encode_slice(data: np.ndarray, bounds: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    start, of_row = _stretches(data, bounds)
    if not len(start):
        return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
    end = np.append(start[1:], len(data))
    hashes, spot, which = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
    known = _known(path)
    if len(known.hashes) > known.LIMIT:
        known.clear()
    place = known.find(hashes)
    fresh = np.flatnonzero(place < 0)
    if len(fresh):
        raw = data.tobytes()
        distinct = [raw[s:e].decode() for s, e in zip(start[spot[fresh]].tolist(), end[spot[fresh]].tolist())]
        encoded = [e.ids for e in load(path).encode_batch_fast(distinct, add_special_tokens=False)]
        size = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded))
        known.add(hashes[fresh], size, np.fromiter(chain.from_iterable(encoded), dtype=np.uint32, count=int(size.sum())))
        place = known.find(hashes)
    lengths = known.size[place][which]
    ends = np.cumsum(lengths)
    take = np.arange(int(ends[-1])) + np.repeat(known.begin[place][which] - (ends - lengths), lengths)
    return known.flat[take], np.concatenate(([0], ends))[of_row]
