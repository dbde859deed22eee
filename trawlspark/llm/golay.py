"""The perfect binary Golay code (23, 12) as an error-tolerant hash of short bit strings."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

_GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, and its parity part below
_WIDTH = 23


def _syndrome(v: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word by the generator polynomial (11 bits)."""
    v = v.copy()
    for shift in range(11, -1, -1):
        top = (v >> (shift + 11)) & 1
        v ^= top * (_GENERATOR << shift)
    return v


@cache
def _by_syndrome() -> np.ndarray:
    """The only error of weight 3 or less that has each of the 2048 syndromes."""
    errors = np.array([sum(1 << b for b in bits) for w in range(4) for bits in combinations(range(_WIDTH), w)])
    s = _syndrome(errors)
    table = np.full(2048, -1)
    table[s] = errors
    if len(set(s.tolist())) != 2048:
        raise AssertionError("the generator doesn't give a perfect code")
    return table


@cache
def key_table(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices near each value of that many bits (at most 16): (keys, starts), a ragged array.

    A value within 2 bits of its codeword has that one index. One at 3 bits has besides the indices
    of the codewords at 4 bits. Any two values that differ in at most one bit share an index.
    """
    values = np.arange(1 << bits)
    errors = _by_syndrome()
    near = values ^ errors[_syndrome(values)]
    weight = np.array([bin(x).count("1") for x in (values ^ near).tolist()])
    lists: list[list[int]] = [[n >> 11] for n in near.tolist()]
    far = np.flatnonzero(weight == 3)
    flips = [1 << b for b in range(_WIDTH)]
    moved = np.stack([values[far] ^ f for f in flips], 1)
    others = moved ^ errors[_syndrome(moved.ravel())].reshape(moved.shape)
    for row, v in enumerate(far.tolist()):
        for c in set(others[row].tolist()) - {int(near[v])}:
            if bin(c ^ v).count("1") == 4:
                lists[v].append(c >> 11)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    return np.array([k for x in lists for k in x], np.int64), starts
