"""The perfect binary Golay code of 23 bits: decoding to the index of the nearest codeword."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
BITS, DATA = 23, 12


def remainder(word: int) -> int:
    for shift in range(BITS - 1, 10, -1):
        if word >> shift & 1:
            word ^= GENERATOR << (shift - 11)
    return word


@cache
def tables() -> tuple[list[np.ndarray], np.ndarray]:
    """Syndromes of each byte of a word, and the error pattern of up to three bits for each of the 2048 syndromes."""
    by_byte = [np.array([remainder((b << 8 * k) & ((1 << BITS) - 1)) for b in range(256)], np.int32) for k in range(3)]
    errors = np.zeros(1 << 11, np.int32)
    for n in range(4):
        for places in combinations(range(BITS), n):
            pattern = sum(1 << p for p in places)
            errors[remainder(pattern)] = pattern
    return by_byte, errors


def index(words: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword nearest to each 23-bit word."""
    by_byte, errors = tables()
    words = words.astype(np.int32)
    syndrome = by_byte[0][words & 255] ^ by_byte[1][words >> 8 & 255] ^ by_byte[2][words >> 16 & 127]
    return (words ^ errors[syndrome]) >> (BITS - DATA)


def nearby(words: np.ndarray, width: int) -> np.ndarray:
    """Indices of each word and of all words one bit away within its lowest ``width`` bits, one row per word.

    Sorted, with repeats as -1: a word within two bits of a codeword has one index, any other at most six.
    """
    flips = np.concatenate([[0], 1 << np.arange(width)]).astype(np.int32)
    found = np.sort(index(words.astype(np.int32)[:, None] ^ flips[None, :]), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found
