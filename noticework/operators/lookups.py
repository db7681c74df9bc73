"""Joins that bring in reference data."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from noticework.functions.dates import month_key


def literal_table(spark: SparkSession, rows: Iterable[tuple], schema: str | StructType) -> DataFrame:
    """A small fixed table; its size is known to the planner, which broadcasts it by itself."""
    return spark.createDataFrame(list(rows), schema)


def prefix_class(df: DataFrame, code: str, stems: DataFrame, lengths: Sequence[int], stem: str = "stem",
                 label: str = "category", default: str | None = None) -> DataFrame:
    """Label of the longest stem the code starts with; a stem of a length not in ``lengths`` is an error.

    One equi join per stem length on the code's leading characters, longest first: rows are
    neither multiplied nor ranked, and with a small stem table nothing is shuffled.
    """
    unlisted = F.raise_error(F.concat(F.lit("stem of unlisted length: "), F.col(stem)))
    size = F.when(F.length(stem).isin(*lengths) | F.col(stem).isNull(), F.length(stem)).otherwise(unlisted)
    unique = stems.groupBy(stem).agg(F.min(label).alias(label)).withColumn("__size", size)
    found: list[Column] = []
    for length in sorted(lengths, reverse=True):
        part = unique.filter(F.col("__size") == length).select(
            F.col(stem).alias(f"__stem{length}"), F.col(label).alias(f"__label{length}"))
        df = df.join(part, F.left(F.col(code), F.lit(length)) == F.col(f"__stem{length}"), "left").drop(f"__stem{length}")
        found.append(F.col(f"__label{length}"))
    if default is not None:
        found.append(F.lit(default))
    return df.withColumn(label, F.coalesce(*found)).drop(*[f"__label{n}" for n in lengths])


def with_parent_labels(codes: DataFrame, labels: DataFrame, code: str, label: str, levels: Mapping[str, int], width: int = 8) -> DataFrame:
    """Labels of a code's ancestors, which are the code cut and padded with zeros."""
    for name, kept in levels.items():
        parent = labels.select(F.col(code).alias("__parent"), F.col(label).alias(name))
        padded = F.rpad(F.left(F.col(code), F.lit(kept)), width, "0")
        codes = codes.join(parent, padded == F.col("__parent"), "left").drop("__parent")
    return codes


def to_base_currency(df: DataFrame, rates: DataFrame, value: str, currency: str, date: Column, base: str = "EUR",
                     name: str = "value_base") -> DataFrame:
    """Value in the base currency: base values pass through, others need that month's rate."""
    known = rates.select(F.col("currency").alias(currency), F.col("month").alias("__month"), F.col("rate").alias("__rate"))
    keyed = df.withColumn("__month", month_key(date))
    converted = F.when(F.col(currency) == base, F.col(value)).otherwise(F.try_divide(F.col(value), F.col("__rate")))
    return keyed.join(known, [currency, "__month"], "left").withColumn(name, converted).drop("__month", "__rate")


def resolve_function(df: DataFrame, code_map: DataFrame, code: str, owner: Column, deferred: str = "BD",
                     unmapped: str = "unmapped") -> DataFrame:
    """Function of a product code, else of its owner, with the source of the decision.

    ``code_map`` holds the code, ``consensus`` and ``band``; codes marked ``deferred`` take
    the owner's function.
    """
    joined = df.join(code_map.select(code, "consensus", "band"), code, "left")
    mapped = F.col("consensus")
    return joined.withColumns({
        "function_source": F.when(mapped.isNull(), unmapped).when(mapped != deferred, "product").otherwise("buyer"),
        "function": F.when(mapped.isNull(), unmapped).when(mapped != deferred, mapped).otherwise(owner),
    })


# Letters alike but for case and accents are equal under this collation of Spark's.
NAME_COLLATION = "UNICODE_CI_AI"


def join_by_collation(left: DataFrame, right: DataFrame, left_on: str, right_on: str, how: str = "inner", collation: str = NAME_COLLATION) -> DataFrame:
    """Equi join on texts that a collation holds equal; both columns come out as they were.

    Spark hashes the collation's own keys, so the join shuffles like one on plain texts.  Unlike a table of
    accents it also equates letters that Unicode does not take apart, such as the German sharp s with a double s.
    """
    one = left.withColumn("__left_key", F.collate(F.col(left_on), collation))
    other = right.withColumn("__right_key", F.collate(F.col(right_on), collation))
    return one.join(other, F.col("__left_key") == F.col("__right_key"), how).drop("__left_key", "__right_key")
