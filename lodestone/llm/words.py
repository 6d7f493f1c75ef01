"""64-bit hashes of the words of many texts at once, as array arithmetic over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A word ends at a blank or a control character from tab to carriage return.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: A word is a run of ASCII letters and digits and of all bytes of other characters.
LETTERS = np.zeros(256, bool)
LETTERS[np.r_[48:58, 97:123, 128:256]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _upto(n: int) -> list[np.ndarray]:
    if len(_powers[0]) <= n:
        size = 1 << (n + 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each 64-bit number over all bits, one to one (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the words of text i, in order, are hashes[bounds[i]:bounds[i + 1]]. A-Z count as a-z."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    b = LOWER[data]
    word = kind[b]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inner] = word[inner]
    ends[inner - 1] = word[inner - 1]
    at, to = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    powers, inverses = _upto(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[b] * powers[: len(data)], out=total[1:])
    return mix((total[to] - total[at]) * inverses[at]), np.searchsorted(at, offsets)
