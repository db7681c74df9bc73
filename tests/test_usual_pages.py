"""Pages of the usual shapes are read by one parse, others give the same notices; rows are dealt evenly."""

import json

from pyspark.sql import functions as F

from noticework.catalogue.entities import order_pages
from noticework.functions.nested import any_equal, any_other_than, total
from noticework.session import dealt_out
from noticework.sources.pages import flatten_pages, shaped_notices

SF_DIR = "/root/testdata/sf0.001"
USUAL = {"publication-number": "1", "buyer-country": ["FRA", None], "title-proc": {"fra": ["Pont"], "deu": "Bau"}, "estimated-value-lot": ["1.5", "n/a", "2"],
         "framework-agreement-lot": ["none", None], "total-value": 7}


def _lines(spark, *notices):
    return spark.createDataFrame([(json.dumps({"notices": list(notices)}), "2024-05")], "page string, month string")


def test_usual_pages_are_not_read_again(spark):
    seen = shaped_notices(order_pages(spark, SF_DIR)).agg(F.count(F.lit(1)).alias("n"), F.count("usual").alias("usual"), F.count("raw").alias("raw")).first()
    assert seen["n"] == seen["usual"] == 2 * spark.read.parquet(f"{SF_DIR}/orders.parquet").count() and seen["raw"] == 0


def test_other_pages_give_the_same_notices(spark):
    columns = ["country_iso3", "lang", "title", "est_value_lots", "framework", "total_value"]
    for change in ({}, {"contract-nature": "works"}, {"main-activity": "[2024] Works"}, {"buyer-legal-type": ""}, {"buyer-name": "Mairie"}, {"total-value": ["7", "8"]}):
        lines = _lines(spark, USUAL | change, None, USUAL)
        got = [tuple(r) for r in flatten_pages(lines).select(*columns).collect()]
        assert got == [("FRA", "fra", "Pont", 3.5, False, 7.0)] * 2, change
    odd = {"buyer-country": "DEU", "contract-nature": '["works"]', "main-activity": "[2024] Works", "title-proc": '{"eng": "Bridge"}', "classification-cpv": [], "eu-fund-lot": "eu-funds"}
    row = flatten_pages(_lines(spark, odd)).first()
    assert (row["country"], row["contract_type"], row["main_activity"], row["lang"], row["title"], row["cpv"], row["eu_funds"]) == ("DE", "W", "[2024] Works", "eng", "Bridge", None, None)
    assert flatten_pages(_lines(spark)).count() == 0


def test_questions_to_lists(value):
    def listed(*texts):
        return F.array(*[F.lit(t).cast("string") for t in texts]).cast("array<string>")
    for texts, equal, other, added in (((), None, None, None), ((None,), None, None, None), (("a",), True, False, None), (("a", None), True, False, None), ((None, "b"), False, True, None),
                                       (("a", "b"), True, True, None), (("1", "x", None, "2.5"), False, True, 3.5)):
        assert value(any_equal(listed(*texts), "a")) is equal and value(any_other_than(listed(*texts), "a")) is other and value(total(listed(*texts))) == added


def test_rows_of_one_row_group_are_dealt_evenly(spark, tmp_path):
    """A file cut into many splits by its bytes, all of whose rows stand in one group."""
    path = str(tmp_path / "t")
    spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500000")
    try:
        df = spark.read.parquet(path)
        cores = spark.sparkContext.defaultParallelism
        assert df.rdd.getNumPartitions() >= cores
        counts = [r["count"] for r in dealt_out(df).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(counts) == 200_000 and max(counts) <= 200_000 // cores


def test_an_order_without_a_key_has_no_number(spark, tmp_path):
    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet").limit(1)
    orders.select(*[F.lit(None).cast(t).alias(c) for c, t in orders.dtypes]).write.parquet(str(tmp_path / "orders.parquet"))
    rows = flatten_pages(order_pages(spark, str(tmp_path))).collect()
    assert [(r["pub_number"], r["form_type"], r["country"], r["total_value"], r["month"]) for r in rows] == [(None, "competition", "FR", None, None), (None, "result", "FR", None, None)]
