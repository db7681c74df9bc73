"""Rows that used to vanish: other headers, malformed pages, missing numbers and missing partition values."""

import pytest

from noticework.plans import reports
from noticework.sources import readers, writers
from noticework.sources.pages import flatten_pages
from noticework.functions.text import notice_number
from noticework.streaming import jobs
from pyspark.sql import functions as F


def test_each_file_keeps_its_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("YEAR,CPV\n2017,33\n")
    (tmp_path / "b.csv").write_text("CPV,YEAR,EXTRA\n44,2018,x\n")
    for line_breaks in (True, False):
        rows = readers.read_text_csv_by_header(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], line_breaks).select("YEAR", "CPV", "EXTRA").collect()
        assert sorted(map(tuple, rows)) == [("2017", "33", None), ("2018", "44", "x")]


def test_malformed_page_stops_the_job(spark):
    lines = spark.createDataFrame([('{"notices": [{"publication-number": "1-2024"', "2024-01")], "page string, month string")
    with pytest.raises(Exception, match="(?i)malformed"):
        flatten_pages(lines).collect()


def test_rerun_adds_no_missing_partition_twice(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, None)], "id long, part string")
    path = str(tmp_path / "t")
    for _ in range(2):
        writers.write_new_partitions(df, path, ["part"])
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_unreadable_target_is_an_error(spark, tmp_path):
    assert writers.existing(spark, str(tmp_path / "none")) is None
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_bytes(b"not parquet at all")
    with pytest.raises(Exception):
        writers.existing(spark, str(tmp_path / "bad")).collect()


def test_upsert_keeps_the_partition_without_value_and_prunes(spark, tmp_path):
    path, source = str(tmp_path / "t"), tmp_path / "s"
    schema = "cell long, month string, n long, asof long"
    batches = [[(1, None, 10, 1), (2, "2024-01", 20, 1), (3, "2024-02", 30, 1)], [(4, None, 40, 2), (2, "2024-01", 21, 2)], [(2, "2024-01", 19, 1)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        jobs.upsert_latest(jobs.file_stream(spark, spark.createDataFrame([], schema).schema, str(source)), path, str(tmp_path / "c"), ["cell"], ["asof"], "month")
    rows = {(r["cell"], r["month"], r["n"]) for r in spark.read.parquet(path).collect()}
    assert rows == {(1, None, 10), (2, "2024-01", 21), (3, "2024-02", 30), (4, None, 40)}
    batch = spark.createDataFrame(batches[2], schema)
    plan = jobs.touched_partitions(spark.read.parquet(path), batch, "month")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "2024-01" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_ids_without_a_year_stay(value):
    assert value(notice_number(F.lit("2023263753"))) == "263753-2023"
    assert value(notice_number(F.lit("X-77"))) == "X-77"


def test_summary_keeps_all_years(spark):
    rows = [(f"{i}-{y}", "cn", f"p{i}-{y}", y, f"a{i}") for y in range(2010, 2024) for i in range(12)]
    made = spark.createDataFrame(rows, "pub_number string, type string, procedure_id string, y int, activity string")
    counts = made.select(F.lit("year").alias("panel"), F.col("y").cast("string").alias("category")).unionByName(made.select(F.lit("activity").alias("panel"), F.col("activity").alias("category"))).groupBy("panel", "category").agg(F.count(F.lit(1)).alias("n"))
    folded = reports.shares.top_and_other(counts, ["panel"], "category", "n", 9, where=F.col("panel").isin("activity")).collect()
    assert sum(r["panel"] == "year" for r in folded) == 14
    assert sum(r["panel"] == "activity" for r in folded) == 10


def test_month_profile_takes_the_last_count_of_calls(spark):
    cn = spark.createDataFrame([("1", "FR", "2024-03-02"), ("2", "DE", "2024-03-09")], "id string, country string, dispatch_date string").withColumn("dispatch_date", F.col("dispatch_date").cast("date"))
    log = [("2024-03-01", "ALL", "competition", 7, "2024-04-01"), ("2024-03-01", "ALL", "competition", 2, "2024-05-01"), ("2024-03-01", "ALL", "result", 50, "2024-05-01"), ("2024-03-01", "FRA", "cn", 1, "2024-04-01")]
    counts = spark.createDataFrame(log, "month string, country string, type string, n int, asof string").withColumn("month", F.col("month").cast("date"))
    row = reports.month_profile(cn, counts, {"FR": "FRA"}).collect()[0]
    assert (row["export_ALL"], row["export_FR"], row["ALL"], row["FRA"]) == (2, 1, 2, 1)


def test_export_coverage_counts_a_notice_once(spark):
    schema = "YEAR string, ISO_COUNTRY_CODE string, ID string, V string, B_FRA_AGREEMENT string, TAL_LOCATION_NUTS string"
    raw = spark.createDataFrame([("2020", "FR", "1", "5", "Y", "FR10"), ("2021", "FR", "1", "5", "Y", "FR10"), ("2021", "FR", "2", None, "N", None)], schema)
    rows = {r["year"]: (r["notices"], r["rows_per_notice"]) for r in reports.export_coverage(raw, "cn", "ID", "V").collect()}
    assert rows == {"2020": (1, 2.0), "2021": (1, 1.0)}
