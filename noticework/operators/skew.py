"""Equi join that splits hot keys before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], pairs_per_task: int = 500_000) -> DataFrame:
    """Inner equi join whose hot keys are spread over many tasks.

    AQE splits partitions by bytes; a join that multiplies short rows is hot long before its
    input is large.  A key with more than ``pairs_per_task`` pairs gets one salt per such share:
    the rows of its longer side are dealt over the salts and those of the shorter one repeated
    once per salt.  Every pair still meets exactly once.
    """
    keys = list(keys)
    sizes = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__lefts")).join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rights")), keys)
    pairs = F.col("__lefts") * F.col("__rights")
    salts = F.least(F.ceil(pairs / F.lit(pairs_per_task)), F.greatest("__lefts", "__rights")).cast("int")
    hot = sizes.filter(pairs > pairs_per_task).select(*keys, salts.alias("__salts"), (F.col("__lefts") >= F.col("__rights")).alias("__deal_left"))

    def salted(side: DataFrame, dealt: Column) -> DataFrame:
        number = F.pmod(F.xxhash64(*[F.col(c) for c in side.columns]), F.col("__salts")).cast("int")
        all_salts = F.sequence(F.lit(0), F.col("__salts") - 1)
        salt = F.when(F.col("__salts").isNull(), F.array(F.lit(0))).when(dealt, F.array(number)).otherwise(all_salts)
        return side.join(hot, keys, "left").withColumn("__salt", F.explode(salt)).drop("__salts", "__deal_left")

    return salted(left, F.col("__deal_left")).join(salted(right, ~F.col("__deal_left")), [*keys, "__salt"]).drop("__salt")
