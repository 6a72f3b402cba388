"""Rolling hashes of byte arrays with numpy."""

from __future__ import annotations

import numpy as np

# An odd multiplier has an inverse modulo 2^64, which turns differences of prefix sums into hashes.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Powers:
    """Powers of the multiplier and of its inverse, made longer as needed."""

    def __init__(self):
        self._up = self._down = np.ones(1, np.uint64)

    def up_to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            size = max(n + n // 8, 1 << 16)
            steps = np.full(size - 1, _BASE, np.uint64), np.full(size - 1, _INVERSE, np.uint64)
            one = np.ones(1, np.uint64)
            self._up, self._down = (np.cumprod(np.concatenate([one, s]), dtype=np.uint64) for s in steps)
        return self._up[:n], self._down[:n]


def prefix_sums(data: np.ndarray, powers: Powers) -> np.ndarray:
    """Sums of byte times power, one more than there are bytes."""
    up, _ = powers.up_to(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return sums


def ranges(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """A hash of each range of bytes, its length included."""
    _, down = powers.up_to(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``h``."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))
