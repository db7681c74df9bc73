"""Collapsing rows, children, procedures, months, nested pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticework.catalogue.registry import BUYER_NOTICE_SQL, HIGH, LOW, NOTICE_SQL, buyer_notices, notices, query, table
from noticework.functions.dates import mixed_day, month_start
from noticework.functions.values import plausible_value
from noticework.operators import entities
from noticework.operators.winners import explode_winners
from noticework.session import dealt_out
from noticework.sources.pages import flatten_pages


@query("collapse_rows", """
SELECT l_orderkey, min(CAST(l_shipdate AS DATE)) AS l_shipdate, min(nullif(l_returnflag, 'N')) AS flag,
       min(l_linestatus) AS l_linestatus, round(sum(l_extendedprice), 2) AS price, max(l_linenumber) AS lots, count(*) AS n_rows
FROM lineitem GROUP BY 1""")
def collapse_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.to_date("l_shipdate").alias("l_shipdate"), F.nullif("l_returnflag", F.lit("N")).alias("flag"),
        "l_linestatus", "l_extendedprice", "l_linenumber")
    return entities.collapse_rows(rows, ["l_orderkey"], ["l_shipdate", "flag", "l_linestatus"],
                                  {"price": F.round(F.sum("l_extendedprice"), 2), "lots": F.max("l_linenumber")})


@query("rollup_children", """
SELECT o_orderkey, o_orderstatus, awards, award_value, best
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS awards, round(sum(l_extendedprice), 2) AS award_value, max(l_quantity) AS best
                       FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def rollup_children(spark, sf_dir):
    parent = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    child = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice", "l_quantity")
    return entities.rollup_children(parent, child, "o_orderkey", {
        "awards": F.count(F.lit(1)), "award_value": F.round(F.sum("l_extendedprice"), 2), "best": F.max("l_quantity")})


@query("semi_children", """
SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1998-09-30')""")
def semi_children(spark, sf_dir):
    first = F.lit("1996-01-01").cast("timestamp_ntz")
    after = F.lit("1998-10-01").cast("timestamp_ntz")
    kept = table(spark, sf_dir, "orders").filter((F.col("o_orderdate") >= first) & (F.col("o_orderdate") < after))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    return entities.keep_children_of(lines, kept.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")


@query("monthly_panel", f"""
WITH {BUYER_NOTICE_SQL}
SELECT type, country, CAST(date_trunc('month', dispatch_date) AS DATE) AS month, count(*) AS notices,
       count(CASE WHEN value_eur <= {HIGH} THEN value_eur END) AS notices_with_value,
       round(sum(CASE WHEN value_eur <= {HIGH} THEN value_eur END), 2) AS value
FROM buyer_notice GROUP BY 1, 2, 3""")
def monthly_panel(spark, sf_dir):
    df = buyer_notices(spark, sf_dir).withColumn("value", F.when(F.col("value_eur") <= HIGH, F.col("value_eur")))
    panel = entities.monthly_panel(df, "dispatch_date", ["type", "country"], "value")
    return panel.withColumn("value", F.round("value", 2))


@query("rows_per_entity", """
SELECT l_linestatus, count(*) AS entities, CAST(sum(n) AS BIGINT) AS n_rows, avg(n) AS rows_per_entity
FROM (SELECT l_linestatus, l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1""")
def rows_per_entity(spark, sf_dir):
    return entities.rows_per_entity(table(spark, sf_dir, "lineitem"), ["l_linestatus", "l_orderkey", "l_linenumber"], ["l_linestatus"])


@query("parse_dates", """
WITH t AS (SELECT o_orderstatus, CAST(o_orderdate AS DATE) AS day,
                  CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%d/%m/%y') WHEN 'O' THEN upper(strftime(o_orderdate, '%d-%b-%y'))
                       ELSE strftime(o_orderdate, '%Y.%m.%d') END AS txt FROM orders),
p AS (SELECT *, CAST(coalesce(try_strptime(txt, '%d/%m/%y'), try_strptime(lower(txt), '%d-%b-%y')) AS DATE) AS parsed FROM t)
SELECT o_orderstatus, CAST(date_trunc('month', day) AS DATE) AS month, count(*) AS n_rows, count(parsed) AS parsed,
       count(*) FILTER (WHERE parsed = day) AS equal, min(parsed) AS first_day, max(parsed) AS last_day
FROM p GROUP BY 1, 2""")
def parse_dates(spark, sf_dir):
    status = F.col("o_orderstatus")
    text = (F.when(status == "F", F.date_format("o_orderdate", "dd/MM/yy")).when(status == "O", F.upper(F.date_format("o_orderdate", "dd-MMM-yy")))
            .otherwise(F.date_format("o_orderdate", "yyyy.MM.dd")))
    df = table(spark, sf_dir, "orders").select("o_orderstatus", F.to_date("o_orderdate").alias("day"), text.alias("txt"))
    df = df.withColumn("parsed", mixed_day(F.col("txt")))
    return df.groupBy("o_orderstatus", month_start(F.col("day")).alias("month")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("parsed").alias("parsed"), F.count_if(F.col("parsed") == F.col("day")).alias("equal"),
        F.min("parsed").alias("first_day"), F.max("parsed").alias("last_day"))


@query("to_procedures", f"""
WITH {NOTICE_SQL},
v AS (SELECT *, CASE WHEN value_eur BETWEEN {LOW} AND {HIGH} AND NOT coalesce(framework, false) THEN value_eur END AS v FROM notice)
SELECT type, proc, min(dispatch_date) AS first_date, count(*) AS notices,
       arg_min(nullif(o_orderpriority, '3-MEDIUM'), (dispatch_date, pub_number)) FILTER (WHERE o_orderpriority <> '3-MEDIUM') AS contract_type,
       bool_or(coalesce(framework, false)) AS framework, round(sum(DISTINCT v), 2) AS value_eur
FROM v GROUP BY 1, 2""")
def to_procedures(spark, sf_dir):
    df = notices(spark, sf_dir).withColumn("contract_type", F.nullif("o_orderpriority", F.lit("3-MEDIUM")))
    procedures = entities.to_procedures(
        df, ["type", "proc"], "dispatch_date", "pub_number", first=["contract_type"], any_true=["framework"],
        distinct_sum={"value_eur": plausible_value(F.col("value_eur"), F.col("framework"), LOW, HIGH)})
    return procedures.withColumn("value_eur", F.round("value_eur", 2))


@query("monthly_procedures", f"""
WITH {BUYER_NOTICE_SQL},
p AS (SELECT type, proc, min(country) AS country, min(dispatch_date) AS first_date, count(*) AS notices FROM buyer_notice GROUP BY 1, 2)
SELECT type, country, CAST(date_trunc('month', first_date) AS DATE) AS month, count(*) AS procedures,
       CAST(sum(notices) AS BIGINT) AS notices, CAST(sum(notices) AS DOUBLE) / count(*) AS ratio
FROM p GROUP BY 1, 2, 3""")
def monthly_procedures(spark, sf_dir):
    procedures = entities.to_procedures(buyer_notices(spark, sf_dir), ["type", "proc"], "dispatch_date", "pub_number", country="country")
    monthly = entities.procedures_per_month(procedures, ["type", "country"])
    return monthly.withColumn("ratio", F.col("notices").cast("double") / F.col("procedures"))


def _notice(priority, status):
    """What the call and the award of an order have in common, with the field shapes of real pages."""
    day = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("+02:00"))
    text = F.col("o_orderkey").cast("string")
    price = F.col("o_totalprice").cast("string")
    none = F.lit(None).cast("string")
    return F.to_json(F.struct(
        day.alias("publication-date"),
        F.array(F.concat(F.lit("P"), text)).alias("procedure-identifier"), F.array(F.lit("FRA"), F.lit("DEU")).alias("buyer-country"),
        F.struct(F.array(F.concat(F.lit("Bâtiment "), text), F.lit("x")).alias("fra"), F.array(F.lit("Bau")).alias("deu")).alias("title-proc"),
        F.when(status == "F", F.array(F.lit("none"), none)).when(status == "O", F.array(F.lit("none"), F.lit("fa-wo-rc"))).alias("framework-agreement-lot"),
        F.array(price, F.lit("n/a"), F.lit("10")).alias("estimated-value-lot"), F.col("o_totalprice").alias("total-value"),
        priority.alias("procedure-type"), F.array(F.concat(F.lit("FR"), F.lpad(text, 6, "0"))).alias("place-of-performance")))


def order_pages(spark, sf_dir):
    """Every order as a page with its month: the call, then the award.

    The two notices differ in number and form only, so the rest is written once.
    """
    orders = dealt_out(table(spark, sf_dir, "orders")).select(
        F.col("o_orderkey").cast("string").alias("number"), _notice(F.col("o_orderpriority"), F.col("o_orderstatus")).alias("rest"),
        F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    rest = F.substring("rest", 2, 2**31 - 1)
    def notice(form, mark):
        number = F.coalesce(F.concat(F.lit('"publication-number":"'), "number", F.lit(f'{mark}",')), F.lit(""))
        return F.concat(F.lit("{"), number, F.lit(f'"form-type":"{form}",'), rest)
    call, award = notice("competition", "-C"), notice("result", "-R")
    return orders.select(F.concat(F.lit('{"notices":['), call, F.lit(","), award, F.lit("]}")).alias("page"), "month")


@query("flatten_json", """
WITH n AS (SELECT o.*, f.form, f.type, f.mark FROM orders o, (VALUES ('competition', 'cn', '-C'), ('result', 'can', '-R')) f(form, type, mark))
SELECT o_orderkey || mark AS pub_number, 'P' || o_orderkey AS procedure_id, CAST(o_orderdate AS DATE) AS pub_date, strftime(o_orderdate, '%Y-%m') AS month,
       form AS form_type, type, 'FR' AS country, 'FRA' AS country_iso3, 'fra' AS lang, 'Bâtiment ' || o_orderkey AS title,
       CASE o_orderstatus WHEN 'F' THEN FALSE WHEN 'O' THEN TRUE END AS framework, o_totalprice + 10.0 AS est_value_lots,
       o_totalprice AS total_value, o_orderpriority AS procedure_type, 'FR' || left(lpad(CAST(o_orderkey AS VARCHAR), 6, '0'), 2) AS nuts2
FROM n""")
def flatten_json(spark, sf_dir):
    return flatten_pages(order_pages(spark, sf_dir)).select("pub_number", "procedure_id", "pub_date", "month", "form_type", "type", "country", "country_iso3",
                                       "lang", "title", "framework", "est_value_lots", "total_value", "procedure_type", "nuts2")


@query("event_properties", """
SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS events, CAST(sum(CAST(props ->> '$.k' AS BIGINT)) AS BIGINT) AS k_sum,
       count(DISTINCT CAST(props ->> '$.k' AS BIGINT)) AS k_values
FROM events GROUP BY 1, 2""")
def event_properties(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    df = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), k.alias("k"))
    return df.groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("events"), F.sum("k").alias("k_sum"), F.count_distinct("k").alias("k_values"))


@query("explode_aligned_lists", """
WITH w AS (
  SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_returnflag, 'S' || l_suppkey AS winner, 1 AS pos FROM lineitem
  UNION ALL
  SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_returnflag, 'B' || l_partkey, 2 FROM lineitem WHERE l_returnflag <> 'N')
SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, winner, CAST(CASE l_returnflag WHEN 'N' THEN 1 ELSE 2 END AS INT) AS n_winners,
       CASE l_returnflag WHEN 'N' THEN 'FRA' WHEN 'R' THEN CASE pos WHEN 1 THEN 'FRA' ELSE 'DEU' END END AS winner_country,
       CASE l_returnflag WHEN 'N' THEN 'I1' WHEN 'R' THEN 'I' || pos END AS winner_id,
       CASE l_returnflag WHEN 'N' THEN 'large' END AS winner_size
FROM w""")
def explode_aligned_lists(spark, sf_dir):
    flag = F.col("l_returnflag")
    s, b = F.concat(F.lit("S"), F.col("l_suppkey")), F.concat(F.lit("B"), F.col("l_partkey"))
    names = F.when(flag == "A", F.array(s, b, s)).when(flag == "R", F.array(s, b)).otherwise(F.array(s))
    countries = F.when(flag == "N", F.array(F.lit("FRA"), F.lit("FRA"))).otherwise(F.array(F.lit("FRA"), F.lit("DEU")))
    ids = F.when(flag == "A", F.array(F.lit("I1"), F.lit("I2"), F.lit("I3"))).when(flag == "R", F.array(F.lit("I1"), F.lit("I2"))).otherwise(F.array(F.lit("I1")))
    keep = ["l_orderkey", "l_partkey", "l_linenumber", "l_suppkey"]
    packed = dealt_out(table(spark, sf_dir, "lineitem")).select(
        *keep, F.to_json(F.struct(names.alias("eng"))).alias("winner_names"), F.to_json(countries).alias("winner_countries"),
        F.to_json(ids).alias("winner_ids"), F.lit('["large"]').alias("winner_sizes"))
    return explode_winners(packed, keep)
