"""Minwise signatures cut into bands, with a sketch of 128 bits beside each band key.

Two rows are candidates if they share a band key; a join on the key drops those whose sketches differ in more bits than a pair at
the threshold does, five standard deviations off, so the exact comparison sees few pairs that are not alike."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64 bits."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """Keys (int64) of the bands of so many consecutive values each; a band's number is part of its key."""
    n, k = values.shape
    bands = k // rows
    v = values[:, : bands * rows].reshape(n, bands, rows).astype(np.uint64)
    key = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), (n, bands)).copy()
    for i in range(rows):
        key = mix64(key ^ (v[:, :, i] + np.uint64(0x9E3779B97F4A7C15)))
    return key.view(np.int64)


def pack_bits(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 columns of bits as two int64."""
    two = np.packbits(bits[:, :128], axis=1).copy().view(">i8").astype(np.int64)
    return two[:, 0], two[:, 1]


def differing(a: str, b: str) -> Column:
    """Bits in which the sketches s1, s2 of rows a and b differ."""
    return sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in ("s1", "s2")), F.lit(0))
