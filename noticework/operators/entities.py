"""From repeated rows to entities: notices, awards, procedures, periods."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticework.functions.dates import month_start


def as_columns(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def collapse_rows(df: DataFrame, keys: Sequence[str | Column], attributes: Sequence[str],
                  measures: Mapping[str, Column] | None = None, rows: str | None = "n_rows") -> DataFrame:
    """One row per entity out of repeated rows.

    The attributes repeat on every row of an entity; where they do not, the smallest known
    value is taken, so that reruns agree.  Map-side partial aggregation keeps a hot entity
    down to one row per task before the shuffle.
    """
    aggregates = [F.min(name).alias(name) for name in attributes]
    aggregates += [expr.alias(name) for name, expr in (measures or {}).items()]
    if rows:
        aggregates.append(F.count(F.lit(1)).alias(rows))
    return df.groupBy(*as_columns(keys)).agg(*aggregates)


def rollup_children(parent: DataFrame, child: DataFrame, key: str, aggregates: Mapping[str, Column]) -> DataFrame:
    """Parents with counts and sums of their children; childless parents keep NULLs."""
    totals = child.groupBy(key).agg(*[expr.alias(name) for name, expr in aggregates.items()])
    return parent.join(totals, key, "left")


def keep_children_of(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Children whose parent survived its own filters."""
    return child.join(parent.select(key), key, "left_semi")


def earliest(value: Column, when: Column, tie: Column) -> Column:
    """Aggregate: the value at the earliest date among rows that have one; ``tie`` orders equal dates."""
    return F.min(F.when(value.isNotNull() & when.isNotNull(), F.struct(when.alias("d"), tie.alias("t"), value.alias("v"))))["v"]


def to_procedures(df: DataFrame, keys: Sequence[str | Column], date: str, tie: str, country: str | None = None,
                  first: Sequence[str] = (), any_true: Sequence[str] = (), distinct_sum: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per procedure, dated at its first notice.

    ``first`` attributes are the first known ones in date order; ``distinct_sum`` adds each
    distinct value of a procedure once (lots repeat the notice total).
    """
    day = F.col(date)
    aggregates: list[Column] = [F.min(day).alias("first_date"), F.count(F.lit(1)).alias("notices")]
    if country:
        aggregates.append(F.min(country).alias(country))
    aggregates += [earliest(F.col(name), day, F.col(tie)).alias(name) for name in first]
    aggregates += [F.bool_or(F.coalesce(F.col(name), F.lit(False))).alias(name) for name in any_true]
    aggregates += [F.sum_distinct(value).alias(name) for name, value in (distinct_sum or {}).items()]
    return df.groupBy(*as_columns(keys)).agg(*aggregates)


def procedures_per_month(procedures: DataFrame, by: Sequence[str], date: str = "first_date") -> DataFrame:
    """Procedures and their notices per month."""
    return procedures.groupBy(*by, month_start(F.col(date)).alias("month")).agg(
        F.count(F.lit(1)).alias("procedures"), F.sum("notices").alias("notices"))


def monthly_panel(df: DataFrame, date: str, by: Sequence[str], value: str, count: str = "notices") -> DataFrame:
    """Rows, rows with a value and the summed value per month and group."""
    return df.groupBy(*by, month_start(F.col(date)).alias("month")).agg(
        F.count(F.lit(1)).alias(count), F.count(value).alias(f"{count}_with_{value}"), F.sum(value).alias(value))


def rows_per_entity(df: DataFrame, entity: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Entities, rows and rows per entity; ``by`` groups must be part of the entity key."""
    per_entity = df.groupBy(*entity).agg(F.count(F.lit(1)).alias("n_rows"))
    return per_entity.groupBy(*by).agg(
        F.count(F.lit(1)).alias("entities"), F.sum("n_rows").alias("n_rows"), F.avg("n_rows").alias("rows_per_entity"))
