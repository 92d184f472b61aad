"""Bit-exact public-domain generators on 64-bit words, in NumPy batches (signed bigint columns hold the words).

Spark's arithmetic is signed and checked, so wrapping products are left to ``uint64`` arrays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The increment and the multipliers of splitmix64, and the multiplier of xoroshiro64*.
GAMMA, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
STAR = 0x9E3779BB


def splitmix64(state: np.ndarray) -> np.ndarray:
    """The outputs for these states (before their increment)."""
    z = state.astype(np.uint64) + np.uint64(GAMMA)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(FIRST)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(SECOND)
    return z ^ (z >> np.uint64(31))


def rotated(x: np.ndarray, k: int, bits: int = 64) -> np.ndarray:
    return (x << x.dtype.type(k)) | (x >> x.dtype.type(bits - k))


def xoshiro256(state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One step of xoshiro256++ for each row of ``state`` (n, 4): outputs and new states."""
    a, b, c, d = (state[:, i].copy() for i in range(4))
    out = rotated(a + d, 23) + a
    t = b << np.uint64(17)
    c ^= a
    d ^= b
    b ^= c
    a ^= d
    c ^= t
    return out, np.stack([a, b, c, rotated(d, 45)], 1)


def xoroshiro64star(state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One step of xoroshiro64* for each row of ``state`` (n, 2), 32-bit words."""
    a, b = state[:, 0].copy(), state[:, 1].copy()
    out = a * np.uint32(STAR)
    b ^= a
    return out, np.stack([rotated(a, 26, 32) ^ b ^ (b << np.uint32(9)), rotated(b, 13, 32)], 1)


def splitmix64_column(seed: int, n: Column) -> Column:
    """The ``n``-th output (from 0) of the generator with this seed."""

    @F.pandas_udf("bigint")
    def draw(places: pd.Series) -> pd.Series:
        state = np.uint64(seed % 2**64) + places.to_numpy().astype(np.uint64) * np.uint64(GAMMA)
        return pd.Series(splitmix64(state).view(np.int64))

    return draw(n)
