"""FLT-05, FUN-05: Bloom filters bit by bit: FNV-1a with a finaliser, two halves as two hashes.

Only for filters that must be equal to the bit; to skip data, use the filters of Parquet.
"""

from __future__ import annotations

import math

import numpy as np

MIN_BITS, MAX_BITS, MAX_PROBES = 64, 2**31, 30
# FNV-1a's basis and prime, and the finaliser's multipliers.
BASIS, PRIME = 14695981039346656037, 1099511628211
MULTIPLIERS = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def probes(bits_per_key: int) -> int:
    return min(max(math.floor(bits_per_key * math.log(2) + 0.5), 1), MAX_PROBES)


def bits(keys: int, bits_per_key: int) -> int:
    return min(max(keys * bits_per_key, MIN_BITS), MAX_BITS) if keys > 0 else MIN_BITS


def hashes(keys: list[bytes]) -> np.ndarray:
    """64-bit hashes, byte by byte over all keys at once."""
    size = np.array([len(k) for k in keys], np.int64)
    raw = np.frombuffer(b"".join(keys), np.uint8).astype(np.uint64)
    start = np.cumsum(size) - size
    h = np.full(len(keys), BASIS, np.uint64)
    for i in range(int(size.max()) if len(size) else 0):
        at = np.flatnonzero(size > i)
        h[at] = (h[at] ^ raw[start[at] + i]) * np.uint64(PRIME)
    for m in MULTIPLIERS:
        h = (h ^ (h >> np.uint64(33))) * np.uint64(m)
    return h ^ (h >> np.uint64(33))


class Bloom:
    def __init__(self, keys: list[bytes], bits_per_key: int = 10):
        keys = list(dict.fromkeys(keys))
        self.m, self.k = bits(len(keys), bits_per_key), probes(bits_per_key)
        self.bits = np.zeros(self.m, bool)
        if keys:
            self.bits[self._places(hashes(keys))] = True

    def _places(self, h: np.ndarray) -> np.ndarray:
        low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)
        i = np.arange(self.k, dtype=np.uint64)[:, None]
        return ((low + i * high) & np.uint64(0xFFFFFFFF)) % np.uint64(self.m)

    def may_hold(self, keys: list[bytes]) -> np.ndarray:
        """False: certainly not among the keys."""
        return self.bits[self._places(hashes(keys))].all(axis=0) if keys else np.zeros(0, bool)
