"""Bloom filters of bounded size over 64-bit keys, built by aggregation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest filter that is broadcast: 2**28 bits, 32 MB.
MOST_BITS = 1 << 28
#: Bits for each key, at least.
BITS_A_KEY = 12


class Bloom:
    """Two probes into a bit table whose size is a power of two."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    def has(self, keys: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.words) * 64 - 1)
        out = np.ones(len(keys), bool)
        for shift in (0, 32):
            at = (keys >> np.uint64(shift)) & mask
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def bits_for(n: int) -> int | None:
    """Bits of a filter for n keys, or None if that is over the limit (then join instead)."""
    bits = 1 << 16
    while bits < BITS_A_KEY * n:
        bits *= 2
    return bits if bits <= MOST_BITS else None


def build(keys: DataFrame, column: str, bits: int) -> Bloom:
    """The driver gets at most bits / 64 words, whatever the number of keys."""
    k = F.col(column)
    at = F.explode(F.array(k.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(k, 32).bitwiseAND(F.lit(bits - 1)))).alias("at")
    one = F.expr("shiftleft(1L, CAST(at & 63 AS INT))")
    got = keys.select(at).groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(one).alias("b")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
    return Bloom(words)
