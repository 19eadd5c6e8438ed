"""Hashes of byte spans, for many spans at once, and bitmaps of hashes that are small enough to broadcast.

Hashes are polynomials as prefix sums modulo 2^64; each byte value stands for a fixed random number, so that equal hashes of different
short spans are as rare as 64 bits allow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap for each hash, and at most (16 MB).
BITS_EACH, MOST_BITS = 32, 1 << 27
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1
_BASE = 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def table(seed: int) -> np.ndarray:
    """256 random numbers, the same in every process."""
    return mix((np.arange(256, dtype=np.uint64) + np.uint64(256 * seed + 1)) * _ODD)


_powers = {1: np.ones(1, np.uint64), -1: np.ones(1, np.uint64)}


def powers(n: int, sign: int) -> np.ndarray:
    """The first n powers of the base (sign 1) or of its inverse (sign -1)."""
    known = _powers[sign]
    if len(known) < n:
        step = np.full(max(n, 2 * len(known)), _BASE if sign > 0 else pow(_BASE, -1, 1 << 64), np.uint64)
        step[0] = 1
        known = _powers[sign] = np.cumprod(step)
    return known[:n]


class Spans:
    """Hashes of spans of `data` (uint8)."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table(seed)[data] * powers(len(data), 1), out=self.sums[1:])
        self.back = powers(len(data) + 1, -1)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all spans of `size` bytes, by start."""
        return (self.sums[size:] - self.sums[:-size]) * self.back[: len(self.sums) - size]


def blocks(texts: list[bytes], together: int):
    """(first, end) of consecutive texts of about `together` bytes."""
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end]) <= together):
            total += len(texts[end])
            end += 1
        yield at, end
        at = end


def passes(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the bitmap: all that are, and a few others."""
    bit = mix(hashes) & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def bitmap_of(hashes: DataFrame, most_bits: int = MOST_BITS, bits_each: int = BITS_EACH) -> Broadcast:
    """A broadcast bitmap of a column of longs. It grows with their number up to `most_bits`; more hashes share bits, so it stops less but never a hash of its own."""
    n = hashes.count()
    bits = min(most_bits, max(1 << 16, 1 << (bits_each * n - 1).bit_length())) if n else 1 << 16

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            bit = mix(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) & np.uint64(bits - 1)
            np.bitwise_or.at(mine, bit >> np.uint64(6), np.uint64(1) << (bit & np.uint64(63)))
        at = np.flatnonzero(mine)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(mine[at].view(np.int64))], names=["at", "word"])

    words = hashes.mapInArrow(folded, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words["at"].to_numpy()] = words["word"].to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(out)
