"""Registry of queries and the views they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFunction = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFunction] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[QueryFunction], QueryFunction]:
    def register(function: QueryFunction) -> QueryFunction:
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return function
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Bounds of a plausible value on the driver tables.
LOW, HIGH = 1000.0, 400000.0

# An order as a notice.  Low-priority orders carry no procedure number, so the notice number
# stands in; urgent orders are frameworks, unspecified ones do not say.
NOTICE_SQL = """
notice AS (
  SELECT o_orderkey, o_custkey, 'N' || o_orderkey AS pub_number,
         CASE WHEN o_orderpriority <> '5-LOW' THEN 'P' || o_custkey END AS procedure_id,
         coalesce(CASE WHEN o_orderpriority <> '5-LOW' THEN 'P' || o_custkey END, 'N' || o_orderkey) AS proc,
         CASE WHEN o_orderstatus = 'F' THEN 'can' ELSE 'cn' END AS type,
         CAST(o_orderdate AS DATE) AS dispatch_date, o_totalprice AS value_eur,
         CASE WHEN o_orderpriority = '1-URGENT' THEN TRUE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN FALSE END AS framework,
         o_orderpriority, o_orderstatus
  FROM orders)"""

# The same with the buyer's country and segment.
BUYER_NOTICE_SQL = NOTICE_SQL + """,
buyer_notice AS (
  SELECT n.*, c_mktsegment AS activity, n_name AS country
  FROM notice n JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"""


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.col("o_orderpriority")
    number = F.concat(F.lit("N"), F.col("o_orderkey"))
    case = F.when(priority != "5-LOW", F.concat(F.lit("P"), F.col("o_custkey")))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", number.alias("pub_number"), case.alias("procedure_id"), F.coalesce(case, number).alias("proc"),
        F.when(F.col("o_orderstatus") == "F", "can").otherwise("cn").alias("type"), F.to_date("o_orderdate").alias("dispatch_date"),
        F.col("o_totalprice").alias("value_eur"),
        F.when(priority == "1-URGENT", True).when(priority != "4-NOT SPECIFIED", False).alias("framework"),
        "o_orderpriority", "o_orderstatus")


def buyer_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    buyers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("activity"), F.col("n_name").alias("country"))
    return notices(spark, sf_dir).join(buyers, "o_custkey")
