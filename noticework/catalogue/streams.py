"""Streaming forms whose result equals the batch result on the same events."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticework.catalogue.registry import query, table
from noticework.session import scratch_path
from noticework.streaming import jobs

_EVENTS = "events"


def _event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, _EVENTS).schema
    return jobs.file_stream(spark, schema, f"{sf_dir.rstrip('/')}/{{{_EVENTS}}}.parquet")


@query("stream_equals_batch", """
SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_equals_batch(spark, sf_dir):
    work = scratch_path(spark, "daily-counts")
    counts = jobs.counts_per_day(_event_stream(spark, sf_dir).select("ts", "event_type"), "ts", ["event_type"], "40 days")
    jobs.log_updates(counts, f"{work}/log", f"{work}/checkpoint")
    return jobs.latest_updates(spark, f"{work}/log", ["day", "event_type"])


@query("stream_deduplicated", """
SELECT event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events GROUP BY 1""")
def stream_deduplicated(spark, sf_dir):
    work = scratch_path(spark, "deduplicated")
    twice = _event_stream(spark, sf_dir).unionByName(_event_stream(spark, sf_dir)).select("ts", "event_id", "event_type", "user_id")
    once = jobs.without_repeats(twice, "ts", ["event_id"], "40 days")
    jobs.run_available(once.writeStream.format("parquet").option("path", f"{work}/events").outputMode("append"), f"{work}/checkpoint")
    return spark.read.parquet(f"{work}/events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("users"))


@query("stream_keep_last", """
SELECT CAST(date_trunc('month', ts) AS DATE) AS month, user_id, event_type, max_by(event_id, (ts, event_id)) AS event_id, max_by(value, (ts, event_id)) AS value
FROM events GROUP BY 1, 2, 3""")
def stream_keep_last(spark, sf_dir):
    work = scratch_path(spark, "keep-last")
    cells = _event_stream(spark, sf_dir).select(F.trunc("ts", "MM").alias("month"), "user_id", "event_type", "ts", "event_id", "value")
    jobs.upsert_latest(cells, f"{work}/cells", f"{work}/checkpoint", ["month", "user_id", "event_type"], ["ts", "event_id"], "month")
    return spark.read.parquet(f"{work}/cells").select("month", "user_id", "event_type", "event_id", "value")
