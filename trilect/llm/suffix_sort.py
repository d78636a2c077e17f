"""Sorting suffixes by their first bytes, and hashed comparisons of single ones."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes that are sorted as one number.
_KEY = 8


class HashedText:
    """A text whose substrings are compared by prefix polynomial hashes modulo 2 ** 64."""

    def __init__(self, text: np.ndarray, reach: int):
        self.text, self.reach = text, reach
        n = len(text)
        values = np.random.default_rng(20240115).integers(1, 1 << 63, 256, dtype=np.uint64)[text]
        powers = np.ones(n + 1, np.uint64)
        inverses = np.ones(n + 1, np.uint64)
        if n:
            powers[1:] = np.cumprod(np.full(n, _BASE, np.uint64))
            inverses[1:] = np.cumprod(np.full(n, _INVERSE, np.uint64))
        self.sums = np.append(np.zeros(1, np.uint64), np.cumsum(values * powers[:-1]))
        self.inverses = inverses

    def hashes(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.inverses[at]

    def common(self, a: np.ndarray, b: np.ndarray, known: int = 0) -> np.ndarray:
        """The common extension of the suffixes at a and b, up to ``reach``, by binary search."""
        low, high = np.full(len(a), known), np.full(len(a), self.reach)
        for _ in range(int(self.reach - known).bit_length()):
            middle = (low + high + 1) // 2
            same = self.hashes(a, middle) == self.hashes(b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, np.maximum(middle - 1, low))
        return low

    def less(self, a: np.ndarray, b: np.ndarray, known: int = 0) -> np.ndarray:
        """Whether the suffix at a comes before that at b within ``reach`` bytes."""
        length = self.common(a, b, known)
        last = len(self.text) - 1
        return (length < self.reach) & (self.text[np.minimum(a + length, last)] < self.text[np.minimum(b + length, last)])


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; behind the end there are zeros."""
    padded = np.append(text, np.zeros(_KEY - 1, np.uint8))
    words = np.zeros(len(text), np.uint64)
    for k in range(_KEY):
        words = (words << np.uint64(8)) | padded[k : k + len(text)]
    return words


def sort_suffixes(text: np.ndarray, starts: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at ``starts`` by their first ``reach`` bytes, and which equal the one before.

    Eight bytes are sorted as numbers, then the next eight within the groups that agree so far, and so
    on; what differs from all others takes part no longer. The last eight may lie over bytes
    that were sorted before. ``text`` has at least ``reach`` >= 8 bytes from every start on.
    """
    if not len(starts):
        return starts, np.zeros(0, bool)
    words = _words(text)
    key = words[starts]
    order = np.argsort(key)
    key, order = key[order], starts[order]
    equal = np.append(False, key[1:] == key[:-1])
    for at in [*range(_KEY, reach - _KEY, _KEY), reach - _KEY]:
        tied = np.flatnonzero(equal | np.append(equal[1:], False))
        if not len(tied):
            break
        group, own = np.cumsum(~equal[tied]), order[tied]
        key = words[own + at]
        by_key = np.argsort(key)
        rank = np.cumsum(np.append(True, key[by_key][1:] != key[by_key][:-1]))
        both = (group[by_key] << 32) | rank
        by_group = np.argsort(both)
        order[tied] = own[by_key[by_group]]
        both = both[by_group]
        equal[tied] = np.append(False, both[1:] == both[:-1])
    return order, equal
