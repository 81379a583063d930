"""Sets of 64-bit keys as bitmaps of bounded size, for tasks that drop most rows before a shuffle.

A bitmap answers "not in the set" for certain and "perhaps" otherwise: it spares work and decides
nothing.  Its size follows the number of keys up to ``MOST`` bits, which bounds what is collected
and broadcast; beyond that it only spares less.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, MOST = 16, 28


def gathered(keys: DataFrame, column: str, per_key: int = 16) -> np.ndarray:
    """Bytes of the bitmap of a long column of well-mixed keys; 2^b bits hold the top b bits of each."""
    bits = int(np.clip(np.ceil(np.log2(max(1, keys.count()) * per_key)), LEAST, MOST))
    at: Column = F.shiftrightunsigned(F.col(column), 64 - bits) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")
    )
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in parts.collect():  # at most 2^MOST / 2^15 rows of 4 kB
        whole = np.frombuffer(row.bits, np.uint8)
        start = (row.part - 1) * 4096
        out[start : start + 4096] = whole[: len(out) - start]
    return out


def shared(keys: DataFrame, column: str) -> Broadcast:
    """The bitmap as a broadcast variable (32 MB at most)."""
    return keys.sparkSession.sparkContext.broadcast(gathered(keys, column))


def perhaps(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each unsigned 64-bit key may be in the set."""
    at = keys >> np.uint64(64 - (8 * len(bitmap)).bit_length() + 1)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
