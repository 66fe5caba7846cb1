"""The perfect binary Golay code of length 23, as numpy tables built from its generator polynomial."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def _rest(word: int) -> int:
    for i in range(22, 10, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - 11)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    high = np.array([_rest(x << 11) for x in range(4096)], dtype=np.int64)
    error = np.full(2048, -1, dtype=np.int64)
    for n in range(4):
        for at in combinations(range(23), n):
            e = sum(1 << i for i in at)
            error[high[e >> 11] ^ (e & 2047)] = e
    assert (error >= 0).all(), "every syndrome has one error of three bits or fewer"
    return high, error


def decode(words: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword within three bits of each 23-bit word."""
    high, error = _tables()
    return (words ^ error[high[words >> 11] ^ (words & 2047)]) >> 11


def near_keys(words: np.ndarray) -> np.ndarray:
    """Indices of the codewords of each word and its 23 neighbours: 24 columns, one or six different values.

    Two words at most two bits apart have a neighbour in common (or are
    neighbours), so they share an index.
    """
    flips = np.concatenate([[0], 1 << np.arange(23)])
    return decode(words[:, None] ^ flips[None, :])
