"""Agreement of two share vectors, on logs, pooled and group by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticework.operators.shares import with_shares


def correlation(a: str, b: str) -> Column:
    """Pearson correlation; NULL where one side does not vary (the built-in fails there)."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def _positive_shares(df: DataFrame, by: Sequence[str], ours: str, official: str) -> DataFrame:
    shared = with_shares(df, by, {ours: "a", official: "b"})
    return shared.filter((F.col("a") > 0) & (F.col("b") > 0)).withColumns({"la": F.ln("a"), "lb": F.ln("b")})


def log_correlation(df: DataFrame, group: str, ours: str, official: str, pooled: str = "ALL") -> DataFrame:
    """Correlation of log shares per group, and one pooled row."""
    cells = _positive_shares(df, [group], ours, official)
    stats = [F.count(F.lit(1)).alias("n"), correlation("la", "lb").alias("r")]
    return cells.groupBy(group).agg(*stats).unionByName(cells.agg(*stats).withColumn(group, F.lit(pooled)))


def log_correlation_by_window(df: DataFrame, group: str, year: str, category: Sequence[str], ours: str, official: str,
                              windows: Sequence[tuple[int, int]]) -> DataFrame:
    """Pooled and median correlation under several year windows, in one pass over the data."""
    spans = F.array(*[F.struct(F.lit(a).alias("from"), F.lit(b).alias("to")) for a, b in windows])
    inside = F.explode(F.filter(spans, lambda w: F.col(year).between(w["from"], w["to"])))
    placed = df.withColumn("w", inside).withColumn("window", F.concat_ws("-", "w.from", "w.to"))
    summed = placed.groupBy("window", group, *category).agg(F.sum(ours).alias(ours), F.sum(official).alias(official))
    cells = _positive_shares(summed, ["window", group], ours, official)
    pooled = cells.groupBy("window").agg(F.count_distinct(group).alias("countries"), correlation("la", "lb").alias("r_pooled"))
    single = cells.groupBy("window", group).agg(correlation("la", "lb").alias("r")).groupBy("window").agg(F.median("r").alias("r_country_median"))
    return pooled.join(single, "window")


def shifted_correlation(cells: DataFrame, group: str, quarter: str, leading: str, following: str, shifts: int) -> DataFrame:
    """Correlation of ``following`` with ``leading`` some quarters earlier, for every shift from 0 to ``shifts``, pooled over the groups.

    ``cells`` has one row per group and first day of a quarter; quarters missing in between count as nought on both sides.
    A group's quarters are filled up, shifted and compared in one pass over its short series.
    """
    spans = cells.groupBy(group).agg(F.min(quarter).alias("__first"), F.max(quarter).alias("__last"))
    grid = spans.select(group, F.explode(F.sequence("__first", "__last", F.expr("INTERVAL 3 MONTHS"))).alias(quarter))
    dense = grid.join(cells, [group, quarter], "left").fillna(0, [leading, following])
    along = Window.partitionBy(group).orderBy(quarter)
    earlier = dense.select(F.col(following).alias("y"), *(F.lag(leading, k).over(along).alias(f"x{k}") for k in range(shifts + 1)))
    pairs = earlier.select("y", F.posexplode(F.array(*(f"x{k}" for k in range(shifts + 1)))).alias("shift", "x")).filter(F.col("x").isNotNull())
    return pairs.groupBy("shift").agg(F.count(F.lit(1)).alias("n"), correlation("y", "x").alias("r"))
