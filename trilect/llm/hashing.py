"""64-bit hashes over numpy arrays."""

from __future__ import annotations

import numpy as np


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers, another for every salt."""
    x = x ^ np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sums_by(groups: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of unsigned 64-bit values by group, modulo 2 ** 64."""
    low = np.bincount(groups, (values & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    high = np.bincount(groups, (values >> np.uint64(32)).astype(np.float64), n)
    return low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))
