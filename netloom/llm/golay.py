"""The perfect binary Golay code [23, 12, 7]: nearest codewords, and all codewords within distance 4.

Every 23-bit word has exactly one codeword within distance 3. A word at distance 3 from it has five more at distance 4, others
have none. So if two words differ in one bit at most, the nearest codeword of the one is among the codewords within
distance 4 of the other.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, a generator of the code (fixed value).
GENERATOR = 0b101011100011
BITS = 23


def syndrome(words: np.ndarray) -> np.ndarray:
    """The remainder of each word by the generator."""
    rest = words.astype(np.int64).copy()
    for bit in range(BITS - 1, 10, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
    return rest


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error of weight 3 at most; five errors of weight 4, or -1 where there are none."""
    def errors(weight: int) -> np.ndarray:
        return np.array([sum(1 << b for b in bits) for bits in combinations(range(BITS), weight)], np.int64)

    near = np.zeros(2048, np.int64)
    for weight in range(1, 4):
        found = errors(weight)
        near[syndrome(found)] = found
    far = np.full((2048, 5), -1, np.int64)
    found = errors(4)
    at = syndrome(found)
    order = np.argsort(at, kind="stable")
    which, start, count = np.unique(at[order], return_index=True, return_counts=True)
    assert (count == 5).all()
    far[which] = found[order].reshape(len(which), 5)
    return near, far


def nearest(words: np.ndarray) -> np.ndarray:
    """The index (0 to 4095) of the codeword nearest to each 23-bit word."""
    return (words ^ tables()[0][syndrome(words)]) >> 11


def around(words: np.ndarray) -> np.ndarray:
    """Six columns: the indices of all codewords within distance 4 of each word; -1 where there are fewer."""
    near, far = tables()
    s = syndrome(words)
    more = np.where(far[s] >= 0, (words[:, None] ^ far[s]) >> 11, -1)
    return np.concatenate([((words ^ near[s]) >> 11)[:, None], more], axis=1)
