"""Vectorised polynomial hashes over the bytes of many texts at once (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np

#: Fixed odd multipliers.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX1 = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; a bijection."""
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


class Powers:
    """Running powers of BASE and of its inverse, grown on demand and kept for the next batch."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if n >= len(self.up):
            size = max(n + 1, 1 << 16)
            steps = np.full(size, BASE, np.uint64)
            steps[0] = 1
            self.up = np.cumprod(steps, dtype=np.uint64)
            steps[1:] = INVERSE
            self.down = np.cumprod(steps, dtype=np.uint64)


class Text:
    """Hashes of any byte ranges of one buffer, by prefix sums modulo 2^64."""

    def __init__(self, data: np.ndarray, powers: Powers) -> None:
        powers.upto(len(data) + 1)
        self.powers = powers
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Equal for equal bytes wherever they stand; the length is mixed in."""
        raw = (self.sums[end] - self.sums[start]) * self.powers.down[start]
        return mixed(raw + (end - start).astype(np.uint64) * MIX1)


def pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """An order-aware hash of two hash columns."""
    return mixed(first * MIX2 + (second ^ (second >> np.uint64(29))) * BASE + np.uint64(1))
