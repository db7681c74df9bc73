"""Jaro-Winkler similarity of two name columns, computed on Arrow batches.

Spark has no built-in for it.  The kernel works on whole batches of candidate pairs as
character matrices, so Python runs once per character position instead of once per row.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Ship the kernel inside the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the measure: bonus per shared leading character, longest rewarded prefix,
# and the plain similarity above which the bonus applies.
PREFIX_BONUS = 0.1
PREFIX_LIMIT = 4
BONUS_FLOOR = 0.7
_CHUNK = 4096


def _characters(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, one padded row per name, and the lengths."""
    packed = np.array(names, dtype=np.str_)
    width = max(packed.dtype.itemsize // 4, 1)
    matrix = packed.astype(f"U{width}").view(np.uint32).reshape(len(names), width)
    return matrix, np.array([len(n) for n in names])


def _matched_in_order(chars: np.ndarray, matched: np.ndarray) -> np.ndarray:
    """Matched characters moved to the front of each row, order kept."""
    order = np.argsort(~matched, axis=1, kind="stable")
    return np.take_along_axis(np.where(matched, chars, 0), order, axis=1)


def _block_similarity(left: list[str], right: list[str]) -> np.ndarray:
    a, la = _characters(left)
    b, lb = _characters(right)
    window = np.maximum(np.maximum(la, lb) // 2 - 1, 0)[:, None]
    columns = np.arange(b.shape[1])[None, :]
    rows = np.arange(len(left))
    inside = columns < lb[:, None]
    free = inside.copy()
    hit_a = np.zeros(a.shape, dtype=bool)
    for i in range(a.shape[1]):
        near = (columns >= i - window) & (columns <= i + window)
        open_slots = free & near & (b == a[:, i : i + 1]) & (i < la)[:, None]
        slot = open_slots.argmax(axis=1)
        found = open_slots[rows, slot]
        free[rows[found], slot[found]] = False
        hit_a[:, i] = found
    hit_b = inside & ~free
    matches = hit_a.sum(axis=1)
    width = min(a.shape[1], b.shape[1])
    swapped = (_matched_in_order(a, hit_a)[:, :width] != _matched_in_order(b, hit_b)[:, :width]).sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        plain = np.where(matches > 0, (matches / la + matches / lb + (matches - swapped) / matches) / 3.0, 0.0)
    both_empty = (la == 0) & (lb == 0)
    plain = np.where(both_empty, 1.0, plain)
    head = min(PREFIX_LIMIT, width)
    same = (a[:, :head] == b[:, :head]) & (np.arange(head)[None, :] < np.minimum(la, lb)[:, None])
    prefix = np.cumprod(same, axis=1).sum(axis=1)
    return np.where(plain > BONUS_FLOOR, plain + PREFIX_BONUS * prefix * (1.0 - plain), plain)


def jaro_winkler_values(left: pd.Series, right: pd.Series) -> pd.Series:
    """Similarities of aligned series; NULL where either name is missing."""
    out = np.full(len(left), np.nan)
    known = np.flatnonzero((left.notna() & right.notna()).to_numpy())
    if len(known):
        a, b = left.to_numpy(dtype=object)[known], right.to_numpy(dtype=object)[known]
        # Pairs of similar length share a chunk, so short names are not padded to the longest.
        order = np.argsort([len(x) + len(y) for x, y in zip(a, b)], kind="stable")
        for start in range(0, len(order), _CHUNK):
            take = order[start : start + _CHUNK]
            out[known[take]] = _block_similarity(list(a[take]), list(b[take]))
    return pd.Series(out).astype("float64").where(~np.isnan(out), None)


@F.pandas_udf(DoubleType())
def jaro_winkler(left: pd.Series, right: pd.Series) -> pd.Series:
    return jaro_winkler_values(left, right)


def least_plain_similarity(threshold: float) -> float:
    """Plain similarity a pair needs at least when its boosted one reaches the threshold."""
    if threshold <= BONUS_FLOOR:
        return threshold
    top = PREFIX_BONUS * PREFIX_LIMIT
    return max((threshold - top) / (1.0 - top), BONUS_FLOOR)


def overlap_factor(threshold: float) -> float:
    """``c`` such that a pair reaching the threshold shares at least ``c*la*lb/(la+lb)`` characters.

    From ``(m/la + m/lb + (m-t)/m)/3 >= J`` with ``t >= 0``: ``m*(la+lb)/(la*lb) >= 3*J - 1``.
    """
    return 3.0 * least_plain_similarity(threshold) - 1.0
