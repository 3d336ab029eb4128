"""The binary Golay code: every 23-bit word lies within 3 bits of exactly one codeword.

Two words that differ in at most two bits have a word between them, one bit or less from both.
Naming every neighbour's codeword therefore gives both a common name: one name where the word is
within two bits of its codeword, six otherwise.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

BITS = 23
NAMES = 6  # the most codewords that the neighbours of one word have
_GENERATOR = 0b110001110101  # fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 divides x^23 + 1


def _remainder(word: int) -> int:
    for shift in range(BITS - 12, -1, -1):
        if word >> (shift + 11) & 1:
            word ^= _GENERATOR << shift
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of single bits, of bytes by place, and the error pattern of each syndrome."""
    single = np.array([_remainder(1 << i) for i in range(BITS)], dtype=np.int32)
    of_byte = np.zeros((3, 256), dtype=np.int32)
    for place in range(3):
        for bit in range(min(8, BITS - 8 * place)):
            has = (np.arange(256) >> bit & 1).astype(bool)
            of_byte[place, has] ^= single[8 * place + bit]
    errors = np.zeros(1 << 11, dtype=np.int32)
    for weight in (1, 2, 3):
        for bits in combinations(range(BITS), weight):
            errors[np.bitwise_xor.reduce(single[list(bits)])] = sum(1 << b for b in bits)
    return single, of_byte, errors


def syndrome(words: np.ndarray) -> np.ndarray:
    _, of_byte, _ = _tables()
    return of_byte[0, words & 255] ^ of_byte[1, words >> 8 & 255] ^ of_byte[2, words >> 16]


def decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit number of the codeword nearest to each 23-bit word."""
    return (words ^ _tables()[2][syndrome(words)]) >> 11


def names(words: np.ndarray) -> np.ndarray:
    """Codeword numbers of each word and its 23 neighbours: ``NAMES`` columns, -1 where fewer."""
    single, _, errors = _tables()
    near = np.empty((len(words), BITS + 1), dtype=np.int32)
    base = syndrome(words)
    near[:, 0] = (words ^ errors[base]) >> 11
    for bit in range(BITS):
        other = words ^ (1 << bit)
        near[:, bit + 1] = (other ^ errors[base ^ single[bit]]) >> 11
    near.sort(axis=1)
    again = np.zeros(near.shape, dtype=bool)
    again[:, 1:] = near[:, 1:] == near[:, :-1]
    near[again] = -1
    return -np.sort(-near, axis=1)[:, :NAMES]
