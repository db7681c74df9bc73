"""Structured Streaming jobs, each run to the end of the available input and restartable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from noticework.operators.ordering import keep_last
from noticework.session import settled
from noticework.sources.pages import flatten_pages
from noticework.sources.readers import MONTH_OF_FILE, month_of_file
from noticework.sources.writers import existing


def run_available(writer: DataStreamWriter, checkpoint: str) -> None:
    """Process what has arrived since the last run, then stop."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def file_stream(spark: SparkSession, schema: StructType, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a directory or glob (a single file has to be written as a glob)."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def ingest_pages(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int | None = None,
                 spread: int | None = None, month_pattern: str = MONTH_OF_FILE) -> None:
    """Parse page files that no earlier run has seen into notices partitioned by month."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.text(source).select(F.col("value").alias("page"), month_of_file(month_pattern).alias("month"))
    if spread:
        lines = lines.repartition(spread)
    writer = flatten_pages(lines).writeStream.format("parquet").option("path", target).option("compression", "zstd").partitionBy("month")
    run_available(writer.outputMode("append"), checkpoint)


def touched_partitions(held: DataFrame, batch: DataFrame, partition: str) -> DataFrame:
    """Rows of the partitions that a batch touches, the one without a value included.

    The few values go into the filter as literals, so only their folders are listed and read.
    """
    kind = batch.schema[partition].dataType
    values = [r[0] for r in batch.select(partition).distinct().collect()]
    own = F.col(partition).cast(kind)
    wanted = own.isin([v for v in values if v is not None])
    if None in values:
        wanted = wanted | own.isNull()
    return held.filter(wanted).withColumn(partition, own).select(*batch.columns)


def upsert_latest(stream: DataFrame, target: str, checkpoint: str, cell: Sequence[str], recency: Sequence[str], partition: str) -> None:
    """Keep one row per cell, however late its correction arrives.

    Each batch rewrites only the partitions it touches.  Replaying a batch after a failure
    gives the same table, because keeping the last row is idempotent.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, _: int) -> None:
        held = existing(spark, target)
        merged = batch
        if held is not None:
            merged = touched_partitions(held, batch, partition).unionByName(batch)
        # The target is read and rewritten, so the merged rows are cut off from it first.
        latest = settled(keep_last(merged, cell, recency), "upsert")
        latest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(partition).parquet(target)

    run_available(stream.writeStream.foreachBatch(merge).outputMode("append"), checkpoint)


def without_repeats(stream: DataFrame, event_time: str, keys: Sequence[str], delay: str) -> DataFrame:
    """Drop repeated notices; state is kept only for ``delay`` of event time."""
    timed = stream.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return timed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def counts_per_day(stream: DataFrame, event_time: str, by: Sequence[str], delay: str) -> DataFrame:
    """Event-time counts per day and group; days behind the watermark leave the state."""
    timed = stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, delay)
    counted = timed.groupBy(F.window(event_time, "1 day"), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.to_date("window.start").alias("day"), *by, "n")


def log_updates(stream: DataFrame, log: str, checkpoint: str) -> None:
    """Append every changed group with its batch number; readers keep the last row per group."""

    def append(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(log)

    run_available(stream.writeStream.foreachBatch(append).outputMode("update"), checkpoint)


def latest_updates(spark: SparkSession, log: str, keys: Sequence[str]) -> DataFrame:
    return keep_last(spark.read.parquet(log), keys, ["batch"]).drop("batch")
