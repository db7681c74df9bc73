"""Shares, indices, totals and reshaped tables on already aggregated data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticework.functions.values import share


def with_shares(df: DataFrame, by: Sequence[str], measures: Mapping[str, str]) -> DataFrame:
    """Share of each row in its group total, for each ``measure -> share name``."""
    group = Window.partitionBy(*by)
    return df.withColumns({name: share(F.col(measure), F.sum(measure).over(group)) for measure, name in measures.items()})


def with_grand_shares(df: DataFrame, measures: Mapping[str, str]) -> DataFrame:
    """Share of each row in the grand total, taken once as a scalar subquery."""
    names = list(measures)
    total = df.agg(F.struct(*[F.sum(m).alias(m) for m in names]).alias("total")).scalar()
    return df.withColumns({measures[m]: share(F.col(m), total[m]) for m in names})


def composition(df: DataFrame, by: Sequence[str], category: Column, weight: Column, keep: Sequence[str],
                other: str = "Other", name: str = "category") -> DataFrame:
    """Share by category inside a group; categories outside ``keep`` are added up under ``other``."""
    label = F.when(category.isin(*keep), category).otherwise(other)
    counted = df.groupBy(*by, label.alias(name)).agg(weight.alias("n"))
    return with_shares(counted, by, {"n": "share"})


def share_among_known(counts: DataFrame, by: Sequence[str], category: str, n: str, unknown: str,
                      least_total: int, least_known: int) -> DataFrame:
    """Composition among rows with a known category, for groups with enough rows."""
    group = Window.partitionBy(*by)
    known = F.sum(F.when(F.col(category) != unknown, F.col(n)).otherwise(0)).over(group)
    return (counts.withColumns({"total": F.sum(n).over(group), "known": known})
            .filter((F.col("total") >= least_total) & (F.col("known") >= least_known) & (F.col(category) != unknown))
            .withColumn("share", share(F.col(n), F.col("known"))))


def with_total_group(df: DataFrame, group: str, by: Sequence[str], measures: Sequence[str], label: str = "ALL") -> DataFrame:
    """The groups plus one group holding their sum; the input's shuffle is reused for both."""
    total = df.groupBy(*by).agg(*[F.sum(m).alias(m) for m in measures]).withColumn(group, F.lit(label))
    wanted = [group, *by, *measures]
    return df.select(*wanted).unionByName(total.select(*wanted))


def index_series(df: DataFrame, group: str, month: str, value: str, base_year: int, trailing: int = 12) -> DataFrame:
    """Index on the base year's monthly mean, and its trailing mean (NULL until the window is full)."""
    series = Window.partitionBy(group)
    last_rows = series.orderBy(month).rowsBetween(-(trailing - 1), 0)
    base = F.avg(F.when(F.year(month) == base_year, F.col(value))).over(series)
    smooth = F.when(F.count(F.lit(1)).over(last_rows) == trailing, F.avg(value).over(last_rows))
    return df.withColumns({"base": base, "idx": share(F.col(value) * 100, base), "idx_trailing": share(smooth * 100, base)})


def densify(df: DataFrame, entity: Sequence[str], grid: Mapping[str, Sequence], fill: Mapping[str, object]) -> DataFrame:
    """Every entity times the given code lists, missing cells filled; rows outside the lists stay as they are.

    The grid comes from exploding short literal lists on the distinct entities, so no
    product of two tables is taken.
    """
    cells = df.select(*entity).distinct()
    for name, values in grid.items():
        cells = cells.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
        cells = cells.withColumn(name, F.col(name).cast(df.schema[name].dataType))
    filled = cells.join(df, [*entity, *grid], "full_outer")
    return filled.withColumns({name: F.coalesce(F.col(name), F.lit(value)) for name, value in fill.items()})


def long_counts(df: DataFrame, panels: Mapping[str, Column], category: str = "category") -> DataFrame:
    """Counts by category for several dimensions at once: one unpivot, one aggregation."""
    cells = F.array(*[F.struct(F.lit(panel).alias("panel"), value.cast("string").alias(category)) for panel, value in panels.items()])
    return (df.select(F.explode(cells).alias("cell")).select("cell.*")
            .filter(F.col(category).isNotNull()).groupBy("panel", category).agg(F.count(F.lit(1)).alias("n")))


def top_and_other(counts: DataFrame, by: Sequence[str], category: str, n: str, keep: int, other: str = "Other", where: Column | None = None) -> DataFrame:
    """Largest ``keep`` categories by name, the rest added up; shares of the group total.

    ``where`` limits the folding to some groups; the others keep all their categories.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(n).desc(), F.col(category)))
    ranked = counts.withColumn("__rank", rank)
    folded = ranked.withColumn(category, F.when((F.col("__rank") > keep) & (F.lit(True) if where is None else where), other).otherwise(F.col(category)))
    return with_shares(folded.groupBy(*by, category).agg(F.sum(n).alias(n)), by, {n: "share"})


def heat_table(cells: DataFrame, row: str, column: str, value: str, rows: int, columns: int) -> DataFrame:
    """Cells of the ``rows`` largest rows and ``columns`` largest known columns by summed ``value``; equal sums go by name."""

    def largest(name: str, k: int) -> DataFrame:
        totals = cells.filter(F.col(name).isNotNull()).groupBy(name).agg(F.sum(value).alias("__total"))
        return totals.orderBy(F.col("__total").desc(), name).limit(k).select(name)

    return cells.join(largest(row, rows), row, "left_semi").join(largest(column, columns), column, "left_semi")


def stacked_shares(df: DataFrame, by: str, part: str, value: str, whole: str, keep: int, other: str = "Other") -> DataFrame:
    """Shares of ``value`` in the total of ``by`` for each part except ``whole`` (what has no part).

    The ``keep`` parts with the largest summed shares stay by name, the rest is added up under ``other``.
    """
    summed = df.groupBy(by, part).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("__value"))
    shared = with_shares(summed, [by], {"__value": "share"}).filter(F.col(part) != whole)
    ranked = shared.groupBy(part).agg(F.sum("share").alias("__total")).orderBy(F.col("__total").desc(), part).limit(keep)
    named = ranked.select(part, F.col(part).alias("__named"))
    folded = shared.join(named, part, "left").withColumn(part, F.coalesce("__named", F.lit(other)))
    return folded.groupBy(by, part).agg(F.sum("share").alias("share"))


def wide(df: DataFrame, rows: Sequence[str], columns: str, values: Sequence, cells: Mapping[str, Column]) -> DataFrame:
    """Pivot with a known list of column values (no extra job to find them); any other value is an error."""
    unlisted = F.raise_error(F.concat(F.lit(f"{columns} holds an unlisted value: "), F.coalesce(F.col(columns).cast("string"), F.lit("NULL"))))
    df = df.withColumn(columns, F.when(F.col(columns).isin(*values), F.col(columns)).otherwise(unlisted))
    table = df.groupBy(*rows).pivot(columns, list(values)).agg(*[expr.alias(name) for name, expr in cells.items()])
    if len(cells) == 1:
        only = next(iter(cells))
        for value in values:
            table = table.withColumnRenamed(str(value), f"{value}_{only}")
    return table


def long(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def rolled_shares(df: DataFrame, by: Sequence[str], levels: Sequence[str], count: str = "n", share_name: str = "share_of_parent") -> DataFrame:
    """Counts of every level of a hierarchy and of its sub-totals, each with its share of the level above.

    ``level`` is the grouping id, so a sub-total is told from a member without a value.  Rows are counted once on the lowest
    level; the sub-totals are added up from those counts, and parents are looked up among them.
    """
    leaves = df.groupBy(*by, *levels).agg(F.count(F.lit(1)).alias("__rows"))
    sets = [[*by, *levels[:depth]] for depth in range(len(levels), -1, -1)]
    rolled = leaves.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in (*by, *levels)]).agg(
        F.grouping_id(*by, *levels).cast("bigint").alias("level"), F.sum("__rows").alias(count))
    # The parent of a row has its last level taken away: one more bit from the right.
    above = F.when(F.col("level") < (1 << len(levels)) - 1, F.shiftleft(F.col("level"), 1) + 1)
    parents = rolled.select("level", *by, *levels, F.col(count).alias("__parent")).withColumnsRenamed({c: f"__{c}" for c in (*by, *levels, "level")})
    same = above == F.col("__level")
    for depth, c in enumerate([*by, *levels]):
        kept = F.lit(True) if c in by else F.col("__level") < 1 << len(levels) - 1 - (depth - len(by))
        same = same & F.when(kept, F.col(c).eqNullSafe(F.col(f"__{c}"))).otherwise(True) if c in levels else same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rolled.join(parents, same, "left").select(*by, *levels, "level", count, F.try_divide(F.col(count).cast("double"), F.col("__parent")).alias(share_name))
