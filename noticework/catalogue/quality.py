"""Coverage, competition, outliers, lags, reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticework.catalogue.registry import BUYER_NOTICE_SQL, HIGH, LOW, NOTICE_SQL, buyer_notices, notices, query, table
from noticework.functions.values import magnitude, plausible_value, yes_share
from noticework.operators import quality
from noticework.operators.shares import densify


@query("coverage_fill_rates", f"""
WITH {NOTICE_SQL},
lines AS (SELECT l_orderkey, count(*) AS lots, max(nullif(l_returnflag, 'N')) AS flag FROM lineitem GROUP BY 1)
SELECT type, CAST(year(dispatch_date) AS INT) AS year, count(DISTINCT proc) AS procedures, count(*) AS notices,
       avg((lots IS NOT NULL)::INT) AS lots, avg((flag IS NOT NULL)::INT) AS flag, avg((procedure_id IS NOT NULL)::INT) AS procedure_id,
       avg(coalesce(framework, false)::INT) AS framework, avg(coalesce(value_eur BETWEEN {LOW} AND {HIGH}, false)::INT) AS value_ok,
       avg(lots) AS rows_per_notice
FROM notice LEFT JOIN lines ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def coverage_fill_rates(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("lots"), F.max(F.nullif("l_returnflag", F.lit("N"))).alias("flag"))
    df = notices(spark, sf_dir).join(lines, "o_orderkey", "left")
    value_ok = F.avg(F.coalesce(F.col("value_eur").between(LOW, HIGH), F.lit(False)).cast("int"))
    return quality.coverage(df, ["type", F.year("dispatch_date").alias("year")], F.col("proc"), filled=["lots", "flag", "procedure_id"],
                            true=["framework"], extra={"value_ok": value_ok, "rows_per_notice": F.avg("lots")})


@query("single_bid_cross_border", f"""
WITH {BUYER_NOTICE_SQL},
bids AS (SELECT l_orderkey, count(*) AS offers FROM lineitem GROUP BY 1),
award AS (SELECT l_orderkey, CASE WHEN l_returnflag <> 'N' THEN n_name END AS winner_country, CASE WHEN l_linestatus = 'F' THEN s_name END AS winner
          FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)
SELECT CAST(year(dispatch_date) AS INT) AS year, country, count(*) AS awards, avg((winner IS NOT NULL)::INT) AS winner,
       avg((winner_country IS NOT NULL)::INT) AS winner_country, avg((off IS NOT NULL)::INT) AS offers, avg((off = 1)::INT) AS single_bid,
       avg(CASE WHEN winner_country IS NOT NULL THEN (winner_country <> country)::INT END) AS cross_border
FROM (SELECT a.*, dispatch_date, country, CASE WHEN o_orderpriority <> '5-LOW' THEN offers END AS off
      FROM award a JOIN buyer_notice ON o_orderkey = a.l_orderkey JOIN bids b ON b.l_orderkey = a.l_orderkey)
GROUP BY 1, 2""")
def single_bid_cross_border(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_returnflag", "l_linestatus")
    bids = lines.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("bids"))
    suppliers = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_name"), F.col("n_name").alias("supplier_country"))
    per_notice = buyer_notices(spark, sf_dir).select("o_orderkey", "dispatch_date", "country", "o_orderpriority").join(bids, "o_orderkey")
    awards = lines.join(suppliers, "l_suppkey").join(per_notice, "o_orderkey")
    abroad = F.when(F.col("l_returnflag") != "N", F.col("supplier_country"))
    return quality.winner_quality(
        awards, [F.year("dispatch_date").alias("year"), "country"], F.when(F.col("l_linestatus") == "F", F.col("s_name")), abroad,
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("bids")), abroad != F.col("country"))


@query("value_outliers", f"""
WITH {NOTICE_SQL}
SELECT type, CAST(year(dispatch_date) AS INT) AS year, count(*) AS with_value, count(*) FILTER (WHERE value_eur < 20000) AS under_low,
       count(*) FILTER (WHERE value_eur > 450000) AS over_high, count(*) FILTER (WHERE value_eur > 490000) AS over_extreme, max(value_eur) AS max_value
FROM notice WHERE value_eur IS NOT NULL GROUP BY 1, 2""")
def value_outliers(spark, sf_dir):
    return quality.value_outliers(notices(spark, sf_dir), ["type", F.year("dispatch_date").alias("year")], F.col("value_eur"), 20000, 450000, 490000)


@query("lag_median_p90", """
SELECT o_orderstatus, CAST(year(o_orderdate) AS INT) AS year, count(*) AS notices, median(lag) AS lag_med, quantile_cont(lag, 0.9) AS lag_p90
FROM (SELECT o_orderstatus, o_orderdate, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS lag
      FROM orders JOIN lineitem ON l_orderkey = o_orderkey) WHERE lag BETWEEN 0 AND 365 GROUP BY 1, 2""")
def lag_median_p90(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.to_date("o_orderdate").alias("start"))
    shipped = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.to_date("l_shipdate").alias("shipped"))
    return quality.lag_report(orders.join(shipped, "o_orderkey"), ["o_orderstatus", F.year("start").alias("year")], F.datediff("shipped", "start"))


@query("call_to_award", """
WITH u AS (SELECT user_id, min(CAST(ts AS DATE)) FILTER (WHERE event_type = 'view') AS c, min(CAST(ts AS DATE)) FILTER (WHERE event_type = 'purchase') AS a
           FROM events GROUP BY 1)
SELECT CAST(date_trunc('month', c) AS DATE) AS month, CAST(day(c) AS INT) AS day, count(*) AS calls, avg((a IS NOT NULL)::INT) AS linked,
       median(date_diff('day', c, a)) AS lag_med_days FROM u WHERE c IS NOT NULL GROUP BY 1, 2""")
def call_to_award(spark, sf_dir):
    kind = F.col("event_type")
    linked = quality.call_to_award(table(spark, sf_dir, "events"), "user_id", F.to_date("ts"), kind == "view", kind == "purchase")
    return quality.linked_lag(linked, [F.trunc("call_day", "MM").alias("month"), F.dayofmonth("call_day").alias("day")], F.col("call_day"), F.col("award_day"))


@query("call_to_award_by_link", """
SELECT CAST(year(c.d) AS INT) AS year, count(*) AS calls, avg((a.d IS NOT NULL)::INT) AS linked, median(date_diff('day', c.d, a.d)) AS lag_med_days
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) c
LEFT JOIN (SELECT l_orderkey, min(CAST(l_shipdate AS DATE)) AS d FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a ON a.l_orderkey = c.o_orderkey
GROUP BY 1""")
def call_to_award_by_link(spark, sf_dir):
    calls = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("call_day"))
    awards = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.min(F.to_date("l_shipdate")).alias("award_day"))
    return quality.linked_lag(calls.join(awards, "o_orderkey", "left"), [F.year("call_day").alias("year")], F.col("call_day"), F.col("award_day"))


@query("reconcile_counts", """
WITH o AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(DISTINCT o_orderkey) AS announced,
                  count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS announced_f FROM orders GROUP BY 1),
l AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, count(DISTINCT l_orderkey) AS counted FROM lineitem GROUP BY 1)
SELECT coalesce(o.month, l.month) AS month, announced, announced_f, counted, coalesce(announced, 0) - coalesce(counted, 0) AS difference,
       CAST(announced AS DOUBLE) / CASE WHEN counted <> 0 THEN counted END AS ratio
FROM o FULL OUTER JOIN l ON o.month = l.month""")
def reconcile_counts(spark, sf_dir):
    left = table(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "MM").alias("month")).agg(
        F.count_distinct("o_orderkey").alias("announced"), F.count_distinct(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("announced_f"))
    right = table(spark, sf_dir, "lineitem").groupBy(F.trunc("l_shipdate", "MM").alias("month")).agg(F.count_distinct("l_orderkey").alias("counted"))
    return quality.reconcile(left, right, ["month"], "announced", "counted")


FIRST_MONTH, LAST_MONTH = "1995-01-01", "2002-12-01"


@query("work_grid", f"""
WITH months AS (SELECT CAST(unnest(generate_series(DATE '{FIRST_MONTH}', DATE '{LAST_MONTH}', INTERVAL 1 MONTH)) AS DATE) AS month),
done AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, c_nationkey AS nation, o_orderpriority AS kind
         FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 50000)
SELECT month, n_nationkey AS nation, kind FROM months, nation, (SELECT DISTINCT o_orderpriority AS kind FROM orders)
EXCEPT SELECT month, nation, kind FROM done""")
def work_grid(spark, sf_dir):
    kinds = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    months = F.sequence(F.lit(FIRST_MONTH).cast("date"), F.lit(LAST_MONTH).cast("date"), F.expr("interval 1 month"))
    grid = (table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.explode(months).alias("month"))
            .withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds]))).select("month", "nation", "kind"))
    counted = table(spark, sf_dir, "orders").filter(F.col("o_totalprice") > 50000).join(
        table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation")), "o_custkey")
    done = counted.select(F.trunc("o_orderdate", "MM").alias("month"), "nation", F.col("o_orderpriority").alias("kind")).distinct()
    return quality.missing_cells(grid, done, ["month", "nation", "kind"])


@query("densify_grid", """
WITH y AS (SELECT CAST(unnest(generate_series(1995, 2002)) AS INT) AS year), s(status) AS (VALUES ('F'), ('O'), ('P'), ('X')),
c AS (SELECT c_nationkey AS nation, CAST(year(o_orderdate) AS INT) AS year, o_orderstatus AS status, count(*) AS n, avg(CASE WHEN o_totalprice > 250000 THEN 1.0 ELSE 0.0 END) AS share
      FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3)
SELECT d.nation, y.year, s.status, coalesce(n, 0) AS n, coalesce(share, 0.0) AS share
FROM (SELECT DISTINCT nation FROM c) d CROSS JOIN y CROSS JOIN s LEFT JOIN c ON c.nation = d.nation AND c.year = y.year AND c.status = s.status""")
def densify_grid(spark, sf_dir):
    buyers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    counted = table(spark, sf_dir, "orders").join(buyers, "o_custkey").groupBy(
        "nation", F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("o_totalprice") > 250000).cast("double")).alias("share"))
    return densify(counted, ["nation"], {"year": list(range(1995, 2003)), "status": ["F", "O", "P", "X"]}, {"n": 0, "share": 0.0})


@query("magnitude_histogram", f"""
WITH {NOTICE_SQL}
SELECT type, CAST(floor(log10(v)) AS INT) AS magnitude, count(*) AS n FROM (SELECT type, CASE WHEN value_eur BETWEEN {LOW} AND {HIGH} AND NOT coalesce(framework, false)
       THEN value_eur END AS v FROM notice) WHERE v IS NOT NULL GROUP BY 1, 2""")
def magnitude_histogram(spark, sf_dir):
    df = notices(spark, sf_dir).withColumn("v", plausible_value(F.col("value_eur"), F.col("framework"), LOW, HIGH)).filter("v is not null")
    return df.groupBy("type", magnitude(F.col("v")).alias("magnitude")).agg(F.count(F.lit(1)).alias("n"))


@query("flag_share", """
SELECT c_nationkey AS nation, CAST(year(o_orderdate) AS INT) AS year, count(*) AS awards, avg((l_returnflag = 'A')::INT) AS flag_share
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2""")
def flag_share(spark, sf_dir):
    flags = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag").isin("A", "R")).select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("year"))
    buyers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    df = flags.join(orders, "o_orderkey").join(buyers, "c_custkey")
    return df.groupBy("nation", "year").agg(F.count(F.lit(1)).alias("awards"), yes_share(F.col("l_returnflag") == "A").alias("flag_share"))
