"""Harmonised codes, stitched sources, currencies, value fallbacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticework.catalogue.registry import query, table
from noticework.functions.codes import by_table, by_words
from noticework.functions.values import first_known_pair
from noticework.operators.lookups import literal_table, to_base_currency
from noticework.operators.ordering import best_rows, keep_last as keep_last_row

# Ordered word rules for part names ("hot" before "old" before the product words).
PART_WORDS = (("hot", "heat"), ("cold", "cooling"), ("ring", "rings"), ("gear", "drive"), ("gizmo", "other"), ("bolt", "fixings"), ("rod", "fixings"))
PRIORITIES = {"1-URGENT": "fast", "2-HIGH": "fast", "3-MEDIUM": "normal", "5-LOW": "slow"}

_PART_CASE = "CASE " + " ".join(f"WHEN p_name ILIKE '%{w}%' THEN '{label}'" for w, label in PART_WORDS) + " END"


@query("harmonise_codes", """
SELECT o_orderstatus, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'fast' WHEN o_orderpriority = '3-MEDIUM' THEN 'normal'
                           WHEN o_orderpriority = '5-LOW' THEN 'slow' WHEN o_orderpriority IS NULL THEN NULL ELSE 'other' END AS pace,
       CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' END AS state, count(*) AS notices
FROM orders GROUP BY 1, 2, 3""")
def harmonise_codes(spark, sf_dir):
    pace = by_table(F.col("o_orderpriority"), PRIORITIES, default="other")
    state = by_table(F.col("o_orderstatus"), {"F": "closed", "O": "open"})
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus", pace.alias("pace"), state.alias("state")).agg(F.count(F.lit(1)).alias("notices"))


@query("code_audit", f"""
SELECT p_name AS raw, {_PART_CASE} AS harmonised, count(*) AS notices FROM part GROUP BY 1, 2 ORDER BY notices DESC, raw LIMIT 25""")
def code_audit(spark, sf_dir):
    audited = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("raw")).agg(F.count(F.lit(1)).alias("notices"))
    audited = audited.select("raw", by_words(F.col("raw"), PART_WORDS).alias("harmonised"), "notices")
    return audited.orderBy(F.col("notices").desc(), "raw").limit(25)


@query("stitch_sources", """
WITH u AS (
  SELECT 'csv' AS source, 'cn' AS type, o_orderkey AS pub_number, CAST(o_orderdate AS DATE) AS dispatch_date, CAST(NULL AS DATE) AS pub_date,
         o_totalprice AS value, 'EUR' AS value_cur FROM orders WHERE o_orderdate < TIMESTAMP '1999-07-01'
  UNION ALL
  SELECT 'api', CASE WHEN o_orderstatus = 'F' THEN 'can' ELSE 'cn' END, o_orderkey, CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + 3,
         o_totalprice * 2, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'USD' END FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01')
SELECT source, type, pub_number, dispatch_date, pub_date, value, value_cur
FROM (SELECT *, row_number() OVER (PARTITION BY type, pub_number ORDER BY source, dispatch_date, value) AS rn FROM u) WHERE rn = 1""")
def stitch_sources(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    old = orders.filter(F.col("o_orderdate") < F.lit("1999-07-01").cast("timestamp_ntz")).select(
        F.lit("csv").alias("source"), F.lit("cn").alias("type"), F.col("o_orderkey").alias("pub_number"), day.alias("dispatch_date"),
        F.lit(None).cast("date").alias("pub_date"), F.col("o_totalprice").alias("value"), F.lit("EUR").alias("value_cur"))
    new = orders.filter(F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp_ntz")).select(
        F.lit("api").alias("source"), F.when(F.col("o_orderstatus") == "F", "can").otherwise("cn").alias("type"),
        F.col("o_orderkey").alias("pub_number"), day.alias("dispatch_date"), F.date_add(day, 3).alias("pub_date"),
        (F.col("o_totalprice") * 2).alias("value"), F.when(F.col("o_orderpriority") != "5-LOW", "USD").alias("value_cur"))
    return best_rows(old.unionByName(new), ["type", "pub_number"], [F.col("source"), F.col("dispatch_date"), F.col("value")])


# Yearly rates of three currencies; months without a rate stay unconverted.
RATES = [(currency, f"{year}-{month:02d}", round(base + 0.01 * (year - 1995) + 0.001 * month, 4))
         for currency, base in (("DKK", 7.4), ("PLN", 4.2), ("SEK", 9.1)) for year in range(1995, 2000) for month in range(1, 13)]
CURRENCIES = {"1-URGENT": "EUR", "2-HIGH": "DKK", "3-MEDIUM": "PLN", "4-NOT SPECIFIED": "SEK"}
_RATE_SQL = ", ".join(f"('{c}', '{m}', {r})" for c, m, r in RATES)


@query("fx_convert", f"""
WITH fx(currency, month, rate) AS (VALUES {_RATE_SQL}),
n AS (SELECT o_orderkey, o_totalprice AS value, CAST(o_orderdate AS DATE) AS d,
             CASE o_orderpriority WHEN '1-URGENT' THEN 'EUR' WHEN '2-HIGH' THEN 'DKK' WHEN '3-MEDIUM' THEN 'PLN' WHEN '4-NOT SPECIFIED' THEN 'SEK' END AS cur
      FROM orders)
SELECT coalesce(cur, 'none') AS cur, strftime(d, '%Y-%m') AS month, count(*) AS notices, count(value) AS with_value,
       count(CASE WHEN cur = 'EUR' THEN value ELSE value / rate END) AS converted,
       round(sum(CASE WHEN cur = 'EUR' THEN value ELSE value / rate END), 2) AS value_eur
FROM n LEFT JOIN fx ON cur = currency AND strftime(d, '%Y-%m') = fx.month GROUP BY 1, 2""")
def fx_convert(spark, sf_dir):
    rates = literal_table(spark, RATES, "currency string, month string, rate double")
    df = table(spark, sf_dir, "orders").select(
        F.col("o_totalprice").alias("value"), F.to_date("o_orderdate").alias("d"), by_table(F.col("o_orderpriority"), CURRENCIES).alias("cur"))
    euro = to_base_currency(df, rates, "value", "cur", F.col("d"), name="value_eur")
    return euro.groupBy(F.coalesce("cur", F.lit("none")).alias("cur"), F.date_format("d", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("notices"), F.count("value").alias("with_value"), F.count("value_eur").alias("converted"),
        F.round(F.sum("value_eur"), 2).alias("value_eur"))


@query("value_fallback", """
WITH a AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 300000 THEN o_totalprice END AS total_value,
                  CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice * 0.9 END AS est_value,
                  CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice * 0.5 END AS lot_value FROM orders)
SELECT o_orderkey, coalesce(total_value, est_value, lot_value) AS value,
       CASE WHEN total_value IS NOT NULL THEN 'EUR' WHEN est_value IS NOT NULL THEN 'USD' END AS currency
FROM a""")
def value_fallback(spark, sf_dir):
    price, status, priority = F.col("o_totalprice"), F.col("o_orderstatus"), F.col("o_orderpriority")
    pair = first_known_pair((F.when((status == "F") & (price > 300000), price), F.lit("EUR")),
                            (F.when(priority == "1-URGENT", price * 0.9), F.lit("USD")),
                            (F.when(priority != "5-LOW", price * 0.5), None))
    return table(spark, sf_dir, "orders").select("o_orderkey", pair["value"].alias("value"), pair["currency"].alias("currency"))


@query("keep_last", """
SELECT user_id, event_type, event_id, ts, value FROM
  (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def keep_last(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return keep_last_row(log, ["user_id", "event_type"], ["ts", "event_id"])
