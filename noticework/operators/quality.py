"""Coverage, competition, outliers, lags and reconciliation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticework.functions.values import filled_share, true_share, yes_share


def coverage(df: DataFrame, by: Sequence[str | Column], entity: Column, filled: Sequence[str] = (), true: Sequence[str] = (),
             extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Distinct entities, rows, fill rates and flag rates per group, in one pass."""
    aggregates = [F.count_distinct(entity).alias("procedures"), F.count(F.lit(1)).alias("notices")]
    aggregates += [filled_share(F.col(c)).alias(c) for c in filled]
    aggregates += [true_share(F.col(c)).alias(c) for c in true]
    aggregates += [expr.alias(name) for name, expr in (extra or {}).items()]
    return df.groupBy(*by).agg(*aggregates)


def winner_quality(df: DataFrame, by: Sequence[str | Column], winner: Column, winner_country: Column, offers: Column, abroad: Column) -> DataFrame:
    """Coverage of the winner and offer fields; single bids and cross-border wins among known ones."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("awards"), filled_share(winner).alias("winner"), filled_share(winner_country).alias("winner_country"),
        filled_share(offers).alias("offers"), yes_share(offers == 1).alias("single_bid"),
        yes_share(F.when(winner_country.isNotNull(), abroad)).alias("cross_border"))


def value_outliers(df: DataFrame, by: Sequence[str | Column], value: Column, low: float = 1e3, high: float = 1e9, extreme: float = 1e10) -> DataFrame:
    return df.filter(value.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("with_value"), F.count_if(value < low).alias("under_low"), F.count_if(value > high).alias("over_high"),
        F.count_if(value > extreme).alias("over_extreme"), F.max(value).alias("max_value"))


def lag_report(df: DataFrame, by: Sequence[str | Column], lag: Column, longest: int = 365) -> DataFrame:
    """Exact median and 90th percentile of day lags.

    The exact percentile keeps one counter per distinct lag, so its state is bounded by the
    admitted days however many rows a group has.
    """
    kept = df.withColumn("__lag", lag).filter(F.col("__lag").between(0, longest))
    return kept.groupBy(*by).agg(F.count(F.lit(1)).alias("notices"), F.median("__lag").alias("lag_med"), F.percentile("__lag", 0.9).alias("lag_p90"))


def linked_lag(df: DataFrame, by: Sequence[str | Column], start: Column, end: Column) -> DataFrame:
    """Calls, the share that found its award, and the median days in between."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), filled_share(end).alias("linked"), F.median(F.datediff(end, start)).alias("lag_med_days"))


def call_to_award(df: DataFrame, key: str, day: Column, is_call: Column, is_award: Column, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """First call and first award of each key in one aggregation; keys without a call drop out."""
    return df.groupBy(key).agg(
        F.min(F.when(is_call, day)).alias("call_day"), F.min(F.when(is_award, day)).alias("award_day"),
        *[expr.alias(name) for name, expr in (extra or {}).items()]).filter(F.col("call_day").isNotNull())


def reconcile(left: DataFrame, right: DataFrame, on: Sequence[str], left_count: str, right_count: str, how: str = "full_outer") -> DataFrame:
    """Two counts side by side with their difference and ratio; cells missing on either side are kept unless ``how`` says otherwise."""
    return left.join(right, list(on), how).withColumns({
        "difference": F.coalesce(left_count, F.lit(0)) - F.coalesce(right_count, F.lit(0)),
        "ratio": F.try_divide(F.col(left_count).cast("double"), F.col(right_count).cast("double"))})


def missing_cells(grid: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Cells of a work grid that still lack a value."""
    return grid.join(done.select(*on), list(on), "left_anti")
