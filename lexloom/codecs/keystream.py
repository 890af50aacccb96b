"""The keystream that hides codec headers: a 32-bit multiplicative generator."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np

#: Multipliers: fixed values of the format.
LOW, MIDDLE = 20021, 346
_MASK = 0xFFFFFFFF


def keystream(seed: int) -> Iterator[int]:
    """Successive 15-bit values."""
    state = seed & _MASK
    while True:
        low = LOW * (state & 0xFFFF) & _MASK
        high = (LOW * (state >> 16) + MIDDLE * state + (low >> 16)) & _MASK
        state = (((high & 0xFFFF) << 16) + (low & 0xFFFF) + 1) & _MASK
        yield high & 0x7FFF


@lru_cache(maxsize=256)
def _low_bytes(seed: int, n: int) -> np.ndarray:
    return np.fromiter(islice(keystream(seed), n), np.uint16, n).astype(np.uint8)


def masked(data: bytes, seed: int, sign: int) -> bytes:
    """Add (sign 1) or subtract (sign -1) the keystream's low bytes."""
    x, low = np.frombuffer(data, np.uint8), _low_bytes(seed, len(data))
    return (x + low if sign > 0 else x - low).tobytes()
