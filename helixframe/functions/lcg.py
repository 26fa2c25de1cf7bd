"""The 64-bit linear congruential generator that seeding and resampling are defined by."""

from __future__ import annotations

# Multiplier, increment and the clustering seed.
MULTIPLIER = 6364136223846793005
INCREMENT = 1442695040888963407
CLUSTER_SEED = 12345678901234567

_MASK = (1 << 64) - 1


class Lcg:
    def __init__(self, state: int):
        self.state = state & _MASK

    @classmethod
    def for_replicate(cls, replicate: int) -> Lcg:
        return cls(replicate * MULTIPLIER + INCREMENT)

    def word(self) -> int:
        """The next 64-bit state."""
        self.state = (self.state * MULTIPLIER + INCREMENT) & _MASK
        return self.state

    def unit(self) -> float:
        """The next number in [0, 1), from the upper 53 bits."""
        return (self.word() >> 11) / float(1 << 53)
