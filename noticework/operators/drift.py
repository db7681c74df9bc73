"""Which fields JSON documents hold, of which kinds, and when that changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Containers inside containers that are looked into.
MAX_LEVELS = 16


def _kind(value: Column) -> Column:
    """JSON kind of a variant value; whole and other numbers are told apart."""
    name = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    return (F.when(name == "BIGINT", "integer").when(name.isin("DECIMAL", "DOUBLE", "FLOAT"), "number").when(name == "VOID", "null")
            .otherwise(F.lower(name)))


def field_kinds(df: DataFrame, by: Sequence[str], document: str, levels: int = MAX_LEVELS) -> DataFrame:
    """Rows (``by``, path, kind, n): how often each path of the documents holds a value of each kind.

    Paths start at ``$``; elements of a list share the path ``[]``.  Kinds: object, array, string, integer, number, boolean and null;
    a text that is no JSON is ``malformed``, a null text is not counted.  Documents nested deeper than ``levels`` are an error.  Each
    level is taken apart by generators inside Spark and added up on the map side.
    """
    read = df.filter(F.col(document).isNotNull()).select(*by, F.try_parse_json(F.col(document)).alias("__value"))
    at = read.filter("__value IS NOT NULL").select(*by, F.lit("$").alias("path"), "__value")
    counts = [read.filter("__value IS NULL").groupBy(*by).agg(F.lit("$").alias("path"), F.lit("malformed").alias("kind"), F.count(F.lit(1)).alias("n")).select(*by, "path", "kind", "n")]
    spark = df.sparkSession
    for level in range(levels):
        counts.append(at.groupBy(*by, "path", _kind(F.col("__value")).alias("kind")).agg(F.count(F.lit(1)).alias("n")))
        parts = at.lateralJoin(spark.tvf.variant_explode(F.col("__value").outer())).select(*by, "path", "key", "value")
        inner = F.concat("path", F.when(F.col("key").isNull(), F.lit("[]")).otherwise(F.concat(F.lit("."), "key")))
        at = parts.select(*by, inner.alias("path"), F.col("value").alias("__value"))
        if at.isEmpty():
            break
    else:
        raise ValueError(f"documents are nested more than {levels} deep")
    table = counts[0]
    for part in counts[1:]:
        table = table.unionByName(part)
    return table


def changes(kinds: DataFrame, period: str, by: Sequence[str] = ()) -> DataFrame:
    """Each period's field kinds next to those of the period before: ``new``, ``kept`` or ``gone``.

    The period before is the latest earlier one that has any document, so a period without documents is no drift; the first
    period's fields are all new.
    """
    periods = kinds.select(*by, period).distinct()
    order = Window.partitionBy(*by).orderBy(period)
    later = periods.select(*by, period, F.lead(period).over(order).alias("__next"))
    before = kinds.join(later, [*by, period]).filter("__next IS NOT NULL").select(
        *by, F.col("__next").alias(period), "path", "kind", F.col("n").alias("n_before"))
    met = kinds.join(before, [*by, period, "path", "kind"], "full_outer")
    change = F.when(F.col("n_before").isNull(), "new").when(F.col("n").isNull(), "gone").otherwise("kept")
    return met.select(*by, period, "path", "kind", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_before", F.lit(0)).alias("n_before"), change.alias("change"))
