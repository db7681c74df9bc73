"""Reconciliations, breakdowns and row choices of the reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticework.catalogue.entities import order_pages
from noticework.catalogue.indicators import DOUBLE_SQL, double_tags
from noticework.catalogue.registry import query, table
from noticework.functions.nested import is_json
from noticework.functions.text import notice_number, other_countries
from noticework.operators.ordering import extreme_rows, order_groups
from noticework.operators.shares import stacked_shares
from noticework.plans import reports
from noticework.plans.register import leading_parents, match_coverage
from noticework.sources.pages import flatten_pages


@query("page_reconciliation", """
WITH logged AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) FILTER (WHERE o_orderstatus <> 'P') AS n FROM orders GROUP BY 1),
parsed AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS parsed FROM orders GROUP BY 1)
SELECT month, form_type, parsed, n AS counted, parsed - n AS difference, CAST(parsed AS DOUBLE) / CASE WHEN n <> 0 THEN n END AS ratio
FROM parsed JOIN logged USING (month), (VALUES ('competition'), ('result')) f(form_type)""")
def page_reconciliation(spark, sf_dir):
    """Parsed pages against a count log in which a later row replaces an earlier one."""
    orders = table(spark, sf_dir, "orders")
    cells = orders.groupBy(F.to_date(F.trunc("o_orderdate", "MM")).alias("month")).agg(
        F.count_if(F.col("o_orderstatus") != "P").alias("n"), F.count(F.lit(1)).alias("wrong"))
    rows = F.array(F.struct(F.lit("ALL").alias("country"), F.lit(1).alias("asof"), F.col("wrong").alias("n")),
                   F.struct(F.lit("ALL").alias("country"), F.lit(2).alias("asof"), F.col("n")),
                   F.struct(F.lit("FRA").alias("country"), F.lit(3).alias("asof"), F.col("wrong").alias("n")))
    log = cells.select("month", F.explode(rows).alias("r")).select("month", "r.*").withColumn("type", F.explode(F.array(F.lit("competition"), F.lit("result"))))
    return reports.page_reconciliation(flatten_pages(order_pages(spark, sf_dir)), log)


@query("page_profile", """
SELECT f.type, count(*) AS notices, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day, 1 AS countries, 1::DOUBLE AS has_value,
       avg(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END) AS framework, CAST(NULL AS DOUBLE) AS eu_funds, 0::DOUBLE AS has_activity, 0::DOUBLE AS has_legal_type,
       1::DOUBLE AS has_procedure_id, 0::DOUBLE AS has_description, 0::DOUBLE AS has_winner_country, 0::DOUBLE AS has_award_date
FROM orders, (VALUES ('cn'), ('can')) f(type) GROUP BY 1""")
def page_profile(spark, sf_dir):
    return reports.page_profile(flatten_pages(order_pages(spark, sf_dir)))


@query("secondary_functions", DOUBLE_SQL + """,
tagged_value AS (SELECT function, sec_div, coalesce(sum(value_eur), 0) AS v FROM d GROUP BY 1, 2),
second AS (SELECT p.function, p.sec_div, p.v / nullif(t.v, 0) AS share FROM tagged_value p JOIN (SELECT function, sum(v) AS v FROM tagged_value GROUP BY 1) t USING (function) WHERE p.sec_div <> 'none'),
best AS (SELECT sec_div FROM second GROUP BY 1 ORDER BY sum(share) DESC, sec_div LIMIT 2)
SELECT function, CASE WHEN sec_div IN (FROM best) THEN sec_div ELSE 'Other' END AS sec_div, round(sum(share), 6) AS share FROM second GROUP BY 1, 2""")
def secondary_functions(spark, sf_dir):
    """Value with a second function by that function: the two largest and the rest."""
    stacked = stacked_shares(double_tags(spark, sf_dir), "function", "sec_div", "value_eur", "none", keep=2)
    return stacked.withColumn("share", F.round("share", 6))


@query("parents_by_value", """
SELECT p_brand AS parent, count(DISTINCT l_suppkey) AS winner_names, count(*) AS awards, round(sum(l_extendedprice), 2) AS value_capped,
       (SELECT min(q.p_type) FROM part q WHERE q.p_brand = part.p_brand) AS hq_iso3
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand ORDER BY 4 DESC, 1 LIMIT 10""")
def parents_by_value(spark, sf_dir):
    """The ten brands with the largest value, each with the first of its headquarters."""
    parts = table(spark, sf_dir, "part")
    won = table(spark, sf_dir, "lineitem").join(parts.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("parent")), "l_partkey")
    matches = won.groupBy("parent", F.col("l_suppkey").alias("winner")).agg(F.count(F.lit(1)).alias("awards"), F.sum("l_extendedprice").alias("value_capped"))
    top = leading_parents(matches, parts.select(F.col("p_brand").alias("parent"), F.col("p_type").alias("hq_iso3")), k=10, by="value_capped")
    return top.withColumn("value_capped", F.round("value_capped", 2))


@query("register_coverage", """
WITH ids AS (SELECT l_suppkey, count(*) AS awards FROM lineitem GROUP BY 1),
known AS (SELECT ids.*, CASE WHEN s_nationkey < 10 THEN 'FR' ELSE 'GB' END AS prefix, s_acctbal > 0 AS listed FROM ids JOIN supplier ON s_suppkey = l_suppkey)
SELECT prefix, count(*) AS ids, CAST(sum(awards) AS BIGINT) AS awards, nullif(count(*) FILTER (WHERE listed), 0) AS matched,
       CAST(sum(awards) FILTER (WHERE listed) AS BIGINT) AS awards_matched
FROM known GROUP BY 1""")
def register_coverage(spark, sf_dir):
    """Register numbers, matched ones and their awards per country prefix."""
    supplier = table(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_acctbal", F.when(F.col("s_nationkey") < 10, "FR").otherwise("UK").alias("country"))
    awards = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("awards"))
    ids = awards.join(supplier, "s_suppkey")
    prefix = F.when(F.col("country") == "UK", "GB").otherwise(F.col("country"))
    listed = supplier.filter("s_acctbal > 0").select("s_suppkey", prefix.alias("prefix"))
    matched = ids.select("s_suppkey", prefix.alias("prefix"), "awards").join(listed, ["s_suppkey", "prefix"])
    return match_coverage(ids, matched)


@query("cross_border_list", """
WITH won AS (SELECT DISTINCT l_orderkey AS o_orderkey, n_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)
SELECT o_orderkey, string_agg(won.n_name, '---' ORDER BY won.n_name) AS countries, bool_or(won.n_name <> home.n_name) AS abroad
FROM won JOIN orders USING (o_orderkey) JOIN customer ON c_custkey = o_custkey JOIN nation home ON home.n_nationkey = c_nationkey GROUP BY 1""")
def cross_border_list(spark, sf_dir):
    """Joined country lists with any country besides the buyer's."""
    nation = table(spark, sf_dir, "nation")
    winners = table(spark, sf_dir, "supplier").join(nation, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("won"))
    buyers = table(spark, sf_dir, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("home"))
    lists = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey").join(winners, "l_suppkey").groupBy("o_orderkey").agg(
        F.array_join(F.array_sort(F.collect_set("won")), "---").alias("countries"))
    df = lists.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").join(buyers, "o_custkey")
    return df.select("o_orderkey", "countries", other_countries(F.col("countries"), F.col("home")).alias("abroad"))


@query("notice_numbers", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'X-' || (10000 + o_orderkey) ELSE o_orderkey || '-' || year(o_orderdate) END AS pub_number FROM orders""")
def notice_numbers(spark, sf_dir):
    """Export numbers in printed form; other spellings stay."""
    key = F.col("o_orderkey")
    raw = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("X-"), (key + 10000).cast("string"))).otherwise(
        F.concat(F.year("o_orderdate").cast("string"), F.lpad(key.cast("string"), 9, "0")))
    return table(spark, sf_dir, "orders").select(key, notice_number(raw).alias("pub_number"))


@query("cast_key_join", """
SELECT event_type, count(*) AS events, count(c_custkey) AS known, count(DISTINCT c_custkey) AS customers
FROM events LEFT JOIN customer ON CAST(user_id AS VARCHAR) = CAST(c_custkey AS VARCHAR) GROUP BY 1""")
def cast_key_join(spark, sf_dir):
    """Left join on keys of different types: both are text first."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), "c_custkey")
    events = table(spark, sf_dir, "events").select("event_type", F.col("user_id").cast("string").alias("id"))
    return events.join(customers, "id", "left").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.count("c_custkey").alias("known"), F.count_distinct("c_custkey").alias("customers"))


@query("month_bounds", """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS first_day, CAST(last_day(o_orderdate) AS DATE) AS last_day,
       CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS next_month, count(*) AS n
FROM orders GROUP BY 1, 2, 3""")
def month_bounds(spark, sf_dir):
    """Orders per month with the bounds a request for that month would use."""
    first = F.trunc("o_orderdate", "MM")
    counted = table(spark, sf_dir, "orders").groupBy(first.alias("first_day")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("first_day", F.last_day("first_day").alias("last_day"), F.add_months("first_day", 1).alias("next_month"), "n")


@query("code_prefix", """
SELECT p_brand, count(*) AS n FROM part WHERE p_brand LIKE 'Brand#1%' GROUP BY 1""")
def code_prefix(spark, sf_dir):
    """A prefix of a code as a filter that reaches the scan."""
    return table(spark, sf_dir, "part").filter(F.col("p_brand").startswith("Brand#1")).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("json_validity", """
WITH t AS (SELECT event_type, CASE WHEN user_id % 3 = 0 THEN left(props, length(props) - 1) ELSE props END AS props FROM events)
SELECT event_type, count(*) FILTER (WHERE json_valid(props)) AS valid, count(*) FILTER (WHERE NOT json_valid(props)) AS broken FROM t GROUP BY 1""")
def json_validity(spark, sf_dir):
    """Valid and cut-off JSON texts."""
    props = F.when(F.col("user_id") % 3 == 0, F.left("props", F.length("props") - 1)).otherwise(F.col("props"))
    df = table(spark, sf_dir, "events").select("event_type", is_json(props).alias("ok"))
    return df.groupBy("event_type").agg(F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("broken"))


_LAG_SQL = """
lags AS (SELECT n_name AS country, o_orderpriority AS kind, count(*) AS n, round(avg(o_totalprice), 2) AS value
         FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2)"""


def _counts(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    buyers = table(spark, sf_dir, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("country"))
    return table(spark, sf_dir, "orders").join(buyers, "o_custkey").groupBy("country", F.col("o_orderpriority").alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 2).alias("value"))


@query("extreme_rows", f"""
WITH {_LAG_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY value, country) AS low, row_number() OVER (PARTITION BY kind ORDER BY value DESC, country) AS high FROM lags)
SELECT 'lowest' AS end_of, kind, country, n, value FROM r WHERE low = 1 UNION ALL SELECT 'highest', kind, country, n, value FROM r WHERE high = 1""")
def lowest_and_highest(spark, sf_dir):
    """Per kind the country with the smallest and the one with the largest mean value."""
    counts = _counts(spark, sf_dir)
    low = extreme_rows(counts, ["kind"], "value", ["country"]).withColumn("end_of", F.lit("lowest"))
    high = extreme_rows(counts, ["kind"], "value", ["country"], largest=True).withColumn("end_of", F.lit("highest"))
    return low.unionByName(high).select("end_of", "kind", "country", "n", "value")


@query("ordered_groups", f"""
WITH {_LAG_SQL},
places AS (SELECT country, CAST(row_number() OVER (ORDER BY sum(n), country) AS INT) AS position FROM lags GROUP BY 1)
SELECT lags.*, position FROM lags JOIN places USING (country)""")
def ordered_groups(spark, sf_dir):
    """Countries placed by their total over all kinds, as a chart would order them."""
    return order_groups(_counts(spark, sf_dir), "country", F.sum("n"))
