"""Min-max hashing of texts: the minimum and the maximum under each permutation, so half as many permutations are evaluated."""

from __future__ import annotations

import numpy as np

AT_ONCE = 1 << 16  #: hashes permuted at once, so that a long text needs no more memory than a short one
PRIME = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(text: str, size: int) -> np.ndarray:
    """Distinct 32-bit hashes of the text's substrings of size characters (of the whole text, if it is shorter)."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = max(1, len(points) - size + 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(size, len(points))):
        h = h * PRIME + points[i : i + n] + np.uint64(1)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((h >> np.uint64(32)).astype(np.uint32))


def permutations(count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return (r.integers(0, 1 << 32, count, dtype=np.uint32) | np.uint32(1))[:, None], r.integers(0, 1 << 32, count, dtype=np.uint32)[:, None]


def minmax(hashes: np.ndarray, perms: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Signature of 2 x permutations values: each permutation's minimum, then each one's maximum."""
    a, b = perms
    low, high = np.full(len(a), np.iinfo(np.uint32).max, np.uint32), np.zeros(len(a), np.uint32)
    for s in range(0, len(hashes), AT_ONCE):
        x = hashes[None, s : s + AT_ONCE] * a
        x ^= b
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        low, high = np.minimum(low, x.min(axis=1)), np.maximum(high, x.max(axis=1))
    return np.concatenate([low, high])
