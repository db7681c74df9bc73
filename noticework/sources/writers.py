"""Writers: parquet products, small CSV reports, append logs and partition-wise reruns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from noticework.sources.readers import CSV_DIALECT


def write_product(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def write_text_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    """CSV files with a header each, in the dialect that the readers expect; one file per task."""
    df.write.mode("overwrite").options(**CSV_DIALECT).option("compression", compression).csv(path)


def write_report(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """A sorted CSV report with a header.  For aggregated tables: it ends in one file."""
    write_text_csv(df.orderBy(*order).coalesce(1), path)


def append_log(df: DataFrame, path: str) -> None:
    """Add rows to a log; readers keep the last row per cell."""
    df.write.mode("append").option("compression", "zstd").parquet(path)


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None where nothing was written yet; any other failure is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_new_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> DataFrame:
    """Write only partitions the target lacks, so that a rerun repeats no finished work.

    Returns the rows that were written.
    """
    done = existing(df.sparkSession, path)
    fresh = df
    if done is not None:
        # A missing partition value is a partition too, hence the null-safe comparison.
        keys = done.select(*[F.col(c).cast(df.schema[c].dataType).alias(f"__done_{c}") for c in partition_by]).distinct()
        same = [df[c].eqNullSafe(keys[f"__done_{c}"]) for c in partition_by]
        fresh = df.join(keys, reduce(and_, same), "left_anti")
    fresh.write.mode("append").option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return fresh


def file_statistics(df: DataFrame, by: Sequence[str], identity: str) -> DataFrame:
    """Rows and distinct identities per written part."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(identity).alias("notices"))
