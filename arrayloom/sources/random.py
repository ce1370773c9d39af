"""SplitMix64, the deterministic generator behind templates and hyperplanes."""

from __future__ import annotations

from math import cos, log, pi, sqrt

import numpy as np

MASK = (1 << 64) - 1


class SplitMix64:
    def __init__(self, seed: int):
        self.state = seed & MASK

    def next_u64(self) -> int:
        self.state = (self.state + 0x9E3779B97F4A7C15) & MASK
        z = self.state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK
        return z ^ (z >> 31)

    def next_f64(self) -> float:
        """In [0, 1), with 53 bits."""
        return (self.next_u64() >> 11) / (1 << 53)

    def next_gaussian(self) -> float:
        """Box-Muller."""
        u, v = max(self.next_f64(), 1e-300), self.next_f64()
        return sqrt(-2 * log(u)) * cos(2 * pi * v)

    def gen_range_i8(self, low: int, high: int) -> int:
        """Between low and high, both included."""
        return low + self.next_u64() % (high - low + 1)

    def array(self, n: int) -> np.ndarray:
        """The next n outputs at once."""
        with np.errstate(over="ignore"):
            z = np.uint64(self.state) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            self.state = (self.state + n * 0x9E3779B97F4A7C15) & MASK
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return z ^ (z >> np.uint64(31))
