"""A Bloom filter over 64-bit hashes, built by Spark and broadcast as bits.

Every hash sets ``PROBES`` bits; bits that fall into one word are joined before and
after the shuffle, so what reaches the driver is the filter and nothing else. It has
at most ``BITS_AT_MOST`` bits; with more hashes than those are made for, it lets more pass.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_HASH, PROBES, BITS_AT_MOST = 10, 4, 1 << 28  # some 1 % false positives; 32 MB
WORD = 6  # 64 bits


def filter_size(hashes: int) -> int:
    """Bits of a filter of so many hashes, as a power of two."""
    return max(10, min(BITS_AT_MOST.bit_length() - 1, (BITS_PER_HASH * max(hashes, 1) - 1).bit_length()))


def _places(h: Column, size: int) -> Column:
    """The bits a hash sets: two halves of the hash, combined."""
    step = F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
    return F.array(*[(h + step * k).bitwiseAND((1 << size) - 1) for k in range(PROBES)])


def bloom(hashes: DataFrame, column: str, count: int) -> Callable[[Column], Column]:
    """A column function: whether a hash may be among ``column`` of ``hashes`` (``count`` rows, about).

    A hash that is there always passes."""
    size = filter_size(count)
    spark = hashes.sparkSession
    words = hashes.select(F.explode(_places(F.col(column), size)).alias("place")).selectExpr(
        f"shiftright(place, {WORD}) AS word", "shiftleft(1L, CAST(place & 63 AS INT)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    got = words.toArrow()
    bits = np.zeros(max(1, (1 << size) >> WORD), np.int64)
    bits[got["word"].to_numpy()] = got["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def passes(places: pa.Array) -> pa.Array:
        at = places.flatten().to_numpy().reshape(-1, PROBES)
        return pa.array(((shared.value[at >> WORD] >> (at & 63)) & 1).astype(bool).all(axis=1))

    return lambda h: passes(_places(h, size))
