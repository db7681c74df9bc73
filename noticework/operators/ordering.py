"""First, last, best and numbered rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticework.operators.entities import as_columns
from noticework.session import settled

_RANK = "__position"


def best_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group.

    Spark turns this into a group limit on both sides of the shuffle: a hot group sends at
    most ``n`` rows per task.
    """
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(_RANK, position).filter(F.col(_RANK) <= n).drop(_RANK)


def keep_last(df: DataFrame, cell: Sequence[str], recency: Sequence[str]) -> DataFrame:
    """Latest row per cell of an append-only log."""
    return best_rows(df, cell, [F.col(c).desc_nulls_last() for c in recency])


def extreme_rows(df: DataFrame, keys: Sequence[str], measure: str, tie: Sequence[str], largest: bool = False) -> DataFrame:
    """Each group's row with the smallest (``largest``: the largest) known measure; equal ones go by ``tie``.

    One partial result per task and group, no sort.
    """
    others = [c for c in df.columns if c not in keys]
    size = -F.col(measure) if largest else F.col(measure)
    row = F.min_by(F.struct(*others), F.struct(size, *tie))
    return df.filter(F.col(measure).isNotNull()).groupBy(*keys).agg(row.alias("__row")).select(*keys, *(F.col(f"__row.{c}").alias(c) for c in others))


def order_groups(df: DataFrame, group: str, measure: Column, name: str = "position") -> DataFrame:
    """``df`` with each group's place (from 1) by its rising total of ``measure``; groups are few, as in a report."""
    totals = df.groupBy(group).agg(measure.alias("__total"))
    places = totals.select(group, F.row_number().over(Window.orderBy("__total", group)).alias(name))
    return df.join(places, group)


def shuffle_key(identity: Column, seed: int | str) -> Column:
    """Reproducible random sort key of a row."""
    return F.md5(F.concat_ws("|", identity.cast("string"), F.lit(str(seed))))


def stratified_sample(df: DataFrame, stratum: str, quotas: Mapping[str, int], default: int, identity: str, seed: int) -> DataFrame:
    """A fixed number of rows per stratum in reproducible random order, with their position."""
    quota: Column | None = None
    for value, size in quotas.items():
        hit = F.col(stratum) == value
        quota = F.when(hit, size) if quota is None else quota.when(hit, size)
    quota = F.lit(default) if quota is None else quota.otherwise(default)
    window = Window.partitionBy(stratum).orderBy(shuffle_key(F.col(identity), seed), F.col(identity))
    largest = max([*quotas.values(), default])
    ranked = df.withColumn("position", F.row_number().over(window)).filter(F.col("position") <= largest)
    return ranked.filter(F.col("position") <= quota)


def _with_offsets(df: DataFrame, bucket: str, order: Sequence[Column], name: str) -> DataFrame:
    """Global row number from ordered buckets: number inside the bucket plus rows in earlier ones.

    Only one count per bucket meets in a single task, never the rows.
    """
    inside = F.row_number().over(Window.partitionBy(bucket).orderBy(*order))
    sizes = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(bucket, before.alias("__before"))
    return (df.withColumn("__inside", inside).join(offsets, bucket)
            .withColumn(name, (F.col("__before") + F.col("__inside")).cast("bigint")).drop("__inside", "__before", bucket))


def number_shuffled(df: DataFrame, identity: str, seed: int | str, name: str = "row_no", hex_digits: int = 3) -> DataFrame:
    """Number rows 1..n in reproducible random order.

    The order key is a hash, so its leading digits cut the table into equal ordered buckets.
    ``identity`` has to be unique.
    """
    keyed = df.withColumn("__key", shuffle_key(F.col(identity), seed)).withColumn("__bucket", F.left("__key", F.lit(hex_digits)))
    return _with_offsets(keyed, "__bucket", [F.col("__key"), F.col(identity)], name).drop("__key")


def number_sorted(df: DataFrame, order: Sequence[str], name: str = "row_no") -> DataFrame:
    """Number rows 1..n in sort order.

    Rows are range-partitioned once and written down, because range boundaries are sampled
    and must not move between counting and numbering.  Equal order values may straddle no
    boundary, so give a unique order.
    """
    ranged = df.repartitionByRange(*as_columns(order)).withColumn("__bucket", F.spark_partition_id())
    return _with_offsets(settled(ranged, "ranges"), "__bucket", as_columns(order), name)


def pack_batches(numbered: DataFrame, size: int, line: Column, row_no: str = "row_no") -> DataFrame:
    """Batches of ``size`` numbered rows, each with one text payload (one line per row)."""
    batch = F.ceil(F.col(row_no) / F.lit(size)).cast("bigint")
    rows = numbered.select(batch.alias("batch_id"), F.col(row_no).alias("__no"), line.alias("__line"))
    ordered = F.array_sort(F.collect_list(F.struct("__no", "__line")))
    return rows.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("codes"),
        F.array_join(F.transform(ordered, lambda r: r["__line"]), "\n").alias("payload"))
