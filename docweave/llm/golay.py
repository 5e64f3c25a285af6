"""The binary Golay code of length 23 as a fuzzy hash, in numpy.

The code has 2^12 words, any two at least 7 bits apart, and every 23-bit word lies within
3 bits of exactly one of them. A word at distance 3 from its code word has five more code
words at distance 4. Together these are the code words that some neighbour at distance at
most one decodes to, so two words that differ in one bit share a key if one of them offers
all its keys and the other its own code word, and words up to two bits apart share a key
if both offer all theirs.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

LENGTH, DATA, CHECK = 23, 12, 11
#: Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def _remainder(words: np.ndarray) -> np.ndarray:
    """Of the polynomials in ``words`` by the generator."""
    words = words.copy()
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        words ^= (words >> bit & 1) * (GENERATOR << (bit - CHECK))
    return words


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and the high 11 bits, and the error pattern of each remainder."""
    low, high = _remainder(np.arange(1 << DATA)), _remainder(np.arange(1 << CHECK) << DATA)
    one = 1 << np.arange(LENGTH)
    two = (one[:, None] | one[None, :]).ravel()
    three = (two[:, None] | one[None, :]).ravel()
    errors = np.unique(np.concatenate([[0], three]))
    pattern = np.zeros(1 << CHECK, dtype=np.int64)
    pattern[_remainder(errors)] = errors
    return low, high, pattern


def decode(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index (12 bits) of the nearest code word and the distance to it."""
    low, high, pattern = tables()
    error = pattern[low[words & (1 << DATA) - 1] ^ high[words >> DATA]]
    return (words ^ error) >> CHECK, np.bitwise_count(error).astype(np.int64)


def fuzzy_keys(words: np.ndarray) -> np.ndarray:
    """Shape (n, 6): the own index first, then those of the code words at distance 4, or -1."""
    own, distance = decode(words)
    out = np.full((len(words), 6), -1, dtype=np.int64)
    out[:, 0] = own
    far = np.flatnonzero(distance == 3)
    near = np.sort(decode(words[far, None] ^ (1 << np.arange(LENGTH)))[0], axis=1)
    fresh = np.ones(near.shape, dtype=bool)
    fresh[:, 1:] = near[:, 1:] != near[:, :-1]
    fresh &= near != own[far, None]
    row, column = np.nonzero(fresh)
    first = np.concatenate([[0], np.cumsum(fresh.sum(1))[:-1]]) if len(far) else np.zeros(0, dtype=np.int64)
    out[far[row], 1 + np.arange(len(row)) - first[row]] = near[row, column]
    return out
