"""Incremental jobs: new files only, late corrections, repeats."""

import datetime as dt
import json

from pyspark.sql import functions as F

from noticework.streaming import jobs


def _page(path, *numbers):
    path.write_text(json.dumps({"notices": [{"publication-number": n, "form-type": "competition"} for n in numbers]}) + "\n")


def test_only_new_pages_are_parsed(spark, tmp_path):
    source, target, checkpoint = tmp_path / "pages", str(tmp_path / "notices"), str(tmp_path / "checkpoint")
    source.mkdir()
    _page(source / "2024-05.jsonl", "1", "2")
    jobs.ingest_pages(spark, str(source), target, checkpoint, spread=2)
    _page(source / "2024-06.jsonl", "3")
    jobs.ingest_pages(spark, str(source), target, checkpoint)
    jobs.ingest_pages(spark, str(source), target, checkpoint)
    rows = sorted((str(r["month"]), r["pub_number"]) for r in spark.read.parquet(target).collect())
    assert rows == [("2024-05", "1"), ("2024-05", "2"), ("2024-06", "3")]


def test_late_corrections_win(spark, tmp_path):
    source, target, checkpoint = str(tmp_path / "log"), str(tmp_path / "cells"), str(tmp_path / "checkpoint")
    schema = "month string, country string, n int, asof int"

    def add(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = jobs.file_stream(spark, spark.createDataFrame([], schema).schema, source, files_per_batch=1)
        jobs.upsert_latest(stream, target, checkpoint, ["month", "country"], ["asof"], "month")
        return {(r["month"], r["country"]): r["n"] for r in spark.read.schema("country string, n int, asof int, month string").parquet(target).collect()}

    add(("2024-01", "FR", None, 1), ("2024-02", "FR", 5, 1))
    assert run() == {("2024-01", "FR"): None, ("2024-02", "FR"): 5}
    add(("2024-01", "FR", 7, 3), ("2024-01", "DE", 2, 3))
    add(("2024-01", "FR", 6, 2))
    assert run() == {("2024-01", "FR"): 7, ("2024-01", "DE"): 2, ("2024-02", "FR"): 5}
    assert run() == {("2024-01", "FR"): 7, ("2024-01", "DE"): 2, ("2024-02", "FR"): 5}


def test_repeats_and_daily_counts(spark, tmp_path):
    source = str(tmp_path / "events")
    schema = "ts timestamp, id int, kind string"
    rows = [(dt.datetime(2024, 1, 1, 5), 1, "a"), (dt.datetime(2024, 1, 1, 6), 2, "a"), (dt.datetime(2024, 1, 1, 6), 2, "a"), (dt.datetime(2024, 1, 2, 1), 3, "b")]
    for row in rows:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(source)
    stream_schema = spark.createDataFrame([], schema).schema
    once = jobs.without_repeats(jobs.file_stream(spark, stream_schema, source, 1), "ts", ["id"], "10 days")
    jobs.run_available(once.writeStream.format("parquet").option("path", str(tmp_path / "once")).outputMode("append"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "once")).count() == 3
    counts = jobs.counts_per_day(jobs.file_stream(spark, stream_schema, source, 1), "ts", ["kind"], "10 days")
    jobs.log_updates(counts, str(tmp_path / "updates"), str(tmp_path / "c2"))
    latest = jobs.latest_updates(spark, str(tmp_path / "updates"), ["day", "kind"])
    batch = spark.read.parquet(source).groupBy(F.to_date("ts").alias("day"), "kind").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, latest.select("day", "kind", "n").collect())) == sorted(map(tuple, batch.collect()))
