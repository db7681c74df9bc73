"""Meeting points of names that may be similar: combinations of their rarest characters, computed on Arrow batches."""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Ship the kernel inside the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Meeting points of a name for one partner length; beyond that the combination gets shorter.
MOST_COMBINATIONS = 512
# Golden section: its multiples spread evenly between 0 and 1.
_TURN = (math.sqrt(5.0) - 1.0) / 2.0
_ROWS = 1 << 18


def combination_sizes(mine: int, partner: int, word: int, factor: float, most: float) -> tuple[int, int] | None:
    """(characters to look at, characters to combine) of a name for partners of one length, or None where no such partner can match.

    ``most`` is a number with a fraction: pairs of lengths round it up at different points, so that a growing block lengthens
    its combinations little by little.

    Such a pair shares ``t`` characters at least.  When both names list their characters from rare to frequent, the first ``k`` that
    they share lie among the first ``length - t + k`` of each list, so the two meet on that combination of ``k``.
    """
    t = math.ceil(factor * mine * partner / (mine + partner) - 1e-9)
    if t > min(mine, partner):
        return None
    turn = (mine + partner) * _TURN % 1.0
    k = min(math.floor(most + turn), max(t - word, 0))
    while k > 1 and math.comb(max(mine, partner) - t + k, k) > MOST_COMBINATIONS:
        k -= 1
    return mine - t + k, k


def _scrambled(values: np.ndarray) -> np.ndarray:
    x = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=4096)
def _combinations(n: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(n), k)), np.int64).reshape(math.comb(n, k), k)


def name_probes(name: str, word: int, block: int, most: float, factor: float, flipped: bool, ranks: dict[tuple[str, int], int]) -> np.ndarray:
    """Meeting points of one name: hashes of block, both lengths and a combination of characters."""
    seen: Counter[str] = Counter()
    listed = []
    for c in name[word:]:
        seen[c] += 1
        # Occurrences beyond the ranked ones count as the rarest.
        listed.append((ranks.get((c, seen[c]), -seen[c]), ord(c), seen[c]))
    listed.sort()
    codes = _scrambled(np.array([c << 16 | k for _, c, k in listed], np.uint64))
    found = []
    for partner in range(math.ceil(len(name) * (factor - 1.0) - 1e-9), math.floor(len(name) / (factor - 1.0) + 1e-9) + 1):
        sizes = combination_sizes(len(name), partner, word, factor, most)
        if sizes is None:
            continue
        lengths = (partner, len(name)) if flipped else (len(name), partner)
        seed = _scrambled(np.array([lengths[0] << 32 | lengths[1]], np.uint64)) ^ np.uint64(block & (1 << 64) - 1)
        # A sum of scrambled codes stands for the combination, whatever its order.
        found.append(_scrambled(codes[_combinations(*sizes)].sum(axis=1, dtype=np.uint64) ^ seed))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


def probing(columns: list[str], factor: float, flipped: bool, ranks: dict[tuple[str, int], int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task function: the first columns of each row once per meeting point.

    The last four columns of a row are its name, the length of its first word, a hash of its block and the characters to combine.
    """
    kept = len(columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [batch.column(i).to_pylist() for i in range(kept, batch.num_columns)]
            points = [name_probes(name, word, block, size, factor, flipped, ranks) for name, word, block, size in zip(*names, strict=True)]
            rows = np.repeat(np.arange(len(points)), [len(p) for p in points])
            meet = np.concatenate(points).view(np.int64) if points else np.empty(0, np.int64)
            for start in range(0, len(rows), _ROWS):
                part = pa.array(rows[start:start + _ROWS])
                yield pa.RecordBatch.from_arrays([pa.array(meet[start:start + _ROWS]), *(batch.column(i).take(part) for i in range(kept))], names=columns)

    return run
