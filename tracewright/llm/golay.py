"""The perfect binary Golay code [23, 12, 7] as a fuzzy hash of 23-bit segments.

Every 23-bit word is within distance 3 of exactly one codeword. The keys of a word are the message indices of the
codewords reached by decoding the word and its 23 neighbours: one index if the word is within distance 2 of its
codeword, else six. Two words at distance 2 or less have a neighbour or word in common, so they share a key.
"""

from __future__ import annotations

import numpy as np

#: Fixed value: generator polynomial of the code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0xC75
BITS, KEYS = 23, 6


def _remainder(word: int) -> int:
    for i in range(BITS - 1, 10, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - 11)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    part = np.array([[_remainder(b << s) if b << s < 1 << BITS else 0 for b in range(256)] for s in (0, 8, 16)], np.int64)
    error = np.zeros(2048, np.int64)
    singles = [1 << i for i in range(BITS)]
    for i, a in enumerate(singles):
        error[_remainder(a)] = a
        for j, b in enumerate(singles[:i]):
            error[_remainder(a | b)] = a | b
            for c in singles[:j]:
                error[_remainder(a | b | c)] = a | b | c
    near = np.empty((2048, KEYS), np.int64)
    for s in range(2048):
        seen = {int(error[s])} | {int(error[s ^ _remainder(1 << i)]) ^ 1 << i for i in range(BITS)}
        row = sorted(seen, key=lambda e: (e != int(error[s]), e))
        near[s] = (row + [row[0]] * KEYS)[:KEYS]
    return part, error, near


_PART, _ERROR, _NEAR = _tables()


def _syndrome(words: np.ndarray) -> np.ndarray:
    return _PART[0][words & 255] ^ _PART[1][words >> 8 & 255] ^ _PART[2][words >> 16]


def nearest_index(words: np.ndarray) -> np.ndarray:
    """Message index (12 bits) of the codeword nearest to each word."""
    return (words ^ _ERROR[_syndrome(words)]) >> 11


def indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[..., 6] message indices of each word and which of them are no repeats."""
    near = _NEAR[_syndrome(words)]
    new = np.ones(near.shape, bool)
    new[..., 1:] = near[..., 1:] != near[..., :1]
    return (words[..., None] ^ near) >> 11, new
