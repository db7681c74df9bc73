"""Reproducible shuffle into shards: a Feistel permutation over global row numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from noticework.llm.common import with_arrow
from noticework.operators.ordering import number_sorted

ROUNDS = 6


def _scramble(half: np.ndarray, key: np.uint64) -> np.ndarray:
    x = (half ^ key) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def round_keys(seed: int) -> np.ndarray:
    """Keys of the rounds, from the seed by a Weyl sequence."""
    return (np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) ^ np.uint64(seed & (1 << 64) - 1)


def half_bits(n: int) -> int:
    """Bits of each half, so that both together number at least ``n`` rows."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def permute(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The place of each row number 0..n-1 in the shuffled order.

    The network permutes the smallest power of four that holds ``n``; places at or above ``n``
    walk on along their cycle until they fall below it, in about four steps at most on average.
    """
    bits = np.uint64(half_bits(n))
    mask = np.uint64((1 << int(bits)) - 1)
    keys = round_keys(seed)
    places = rows.astype(np.uint64)
    walking = np.arange(len(places))
    while len(walking):
        left, right = places[walking] >> bits, places[walking] & mask
        for key in keys:
            left, right = right, left ^ (_scramble(right, key) & mask)
        places[walking] = (left << bits) | right
        walking = walking[places[walking] >= np.uint64(n)]
    return places.astype(np.int64)


def locate(rows: np.ndarray, n: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, slot) of each row number: computed from the number alone, with no table."""
    places = permute(rows, n, seed)
    return places % shards, places // shards


def shard_rows(rows: DataFrame, order: list[str], shards: int, seed: int, row_no: str = "row_no", shard: str = "shard", slot: str = "slot") -> DataFrame:
    """``rows`` with their global number (from 0, by ``order``), shard and gapless slot.

    Shards differ by one row at most.  Rows equal in all ``order`` columns share their numbers out
    among themselves in any way; null sorts first.  Give narrow rows: they are written down once.
    """
    numbered = number_sorted(rows, order, row_no).withColumn(row_no, F.col(row_no) - 1)
    n = rows.count()

    def compute(numbers: pa.Array) -> list[pa.Array]:
        shard_of, slot_of = locate(numbers.to_numpy(), n, shards, seed)
        return [pa.array(shard_of.astype(np.int32)), pa.array(slot_of)]

    return with_arrow(numbered, [row_no], StructType([StructField(shard, IntegerType()), StructField(slot, LongType())]), compute)
