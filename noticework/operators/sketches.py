"""Counts and quantiles that merge: sketches per month are written once, longer periods add them up without the notices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Two to this power counters or hashes are kept; the standard errors of a count follow from their number.
COUNT_BITS = 12
HLL_ERROR = 1.04 / 2 ** (COUNT_BITS / 2)
THETA_ERROR = 1.0 / 2 ** (COUNT_BITS / 2)
# Accuracy parameter of the quantile sketch, and the rank error that it promises with 99 % confidence.
QUANTILE_K = 200
RANK_ERROR = 0.0165


def count_sketches(df: DataFrame, by: Sequence[str | Column], identity: Column, name: str = "entities") -> DataFrame:
    """One HLL sketch of distinct ``identity`` and one theta sketch per group; null identities are not counted."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(identity, COUNT_BITS).alias(f"{name}_hll"), F.theta_sketch_agg(identity, COUNT_BITS).alias(f"{name}_theta"))


def merged_counts(sketches: DataFrame, by: Sequence[str | Column], name: str = "entities") -> DataFrame:
    """Distinct counts of longer periods from the sketches of shorter ones, with the merged theta sketch for set questions."""
    return sketches.groupBy(*by).agg(
        F.hll_sketch_estimate(F.hll_union_agg(f"{name}_hll")).alias(name), F.theta_union_agg(f"{name}_theta", COUNT_BITS).alias(f"{name}_theta"))


def overlap(left: Column, right: Column) -> Column:
    """Estimated number of entities that two theta sketches have in common."""
    return F.theta_sketch_estimate(F.theta_intersection(left, right))


def quantile_sketches(df: DataFrame, by: Sequence[str | Column], measure: Column, name: str = "measure") -> DataFrame:
    """One KLL sketch of a measure and its number of known values per group."""
    value = measure.cast("double")
    return df.groupBy(*by).agg(F.kll_sketch_agg_double(value, QUANTILE_K).alias(f"{name}_kll"), F.count(measure).alias(name))


def merged_quantiles(sketches: DataFrame, by: Sequence[str | Column], shares: dict[str, float], name: str = "measure") -> DataFrame:
    """Quantiles of longer periods: ``shares`` maps a column to the share of values that lies below it."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double(f"{name}_kll", QUANTILE_K).alias("__kll"), F.sum(name).alias(name))
    return merged.withColumns({c: F.kll_sketch_get_quantile_double("__kll", F.lit(p)) for c, p in shares.items()}).drop("__kll")
