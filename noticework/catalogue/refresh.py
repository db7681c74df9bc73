"""Refreshing at scale: chains of corrections, sketches that merge, keyed state, stream joins, functions called from SQL text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from noticework.catalogue.quality import FIRST_MONTH, LAST_MONTH
from noticework.catalogue.registry import BUYER_NOTICE_SQL, NOTICE_SQL, buyer_notices, notices, query, table
from noticework.catalogue.streams import _event_stream
from noticework.functions import sql
from noticework.functions.text import clipped
from noticework.operators import chains, conditions, quality, sketches
from noticework.operators.correlation import shifted_correlation
from noticework.operators.ordering import number_sorted
from noticework.operators.shares import rolled_shares
from noticework.session import scratch_path, settled
from noticework.streaming import jobs, keyed

# An order that is not of low priority corrects its customer's order before.
_LINKS_SQL = """
links AS (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day,
         CASE WHEN o_orderpriority <> '5-LOW' THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) END AS corrects FROM orders)"""


@query("correction_chains", f"""
WITH RECURSIVE {_LINKS_SQL},
walk AS (
  SELECT o_orderkey, o_orderkey AS here, 0 AS steps FROM links
  UNION ALL SELECT w.o_orderkey, l.corrects, w.steps + 1 FROM walk w JOIN links l ON l.o_orderkey = w.here WHERE l.corrects IS NOT NULL),
firsts AS (SELECT o_orderkey, arg_max(here, steps) AS first_version FROM walk GROUP BY 1)
SELECT o_orderkey, first_version, last_value(o_orderkey) OVER chain AS latest_version, count(*) OVER chain AS versions, FALSE AS cyclic
FROM firsts JOIN links USING (o_orderkey)
WINDOW chain AS (PARTITION BY first_version ORDER BY day, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def correction_chains(spark, sf_dir):
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    links = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("day"), F.when(F.col("o_orderpriority") != "5-LOW", before).alias("corrects"))
    found = chains.latest_versions(settled(links, "links"), "o_orderkey", "corrects", ["day"])
    return found.select("o_orderkey", "first_version", "latest_version", "versions", "cyclic")


# Calls and awards of the same buyers: two sources that overlap.
@query("merged_distinct_counts", f"""
WITH {NOTICE_SQL},
yearly AS (SELECT CAST(year(dispatch_date) AS INT) AS year, o_custkey, bool_or(type = 'cn') AS called, bool_or(type = 'can') AS awarded FROM notice GROUP BY 1, 2)
SELECT year, count(*) FILTER (WHERE called) AS calling, count(*) FILTER (WHERE awarded) AS awarding, count(*) FILTER (WHERE called AND awarded) AS doing_both,
       TRUE AS calling_within, TRUE AS awarding_within, TRUE AS both_within FROM yearly GROUP BY 1""")
def merged_distinct_counts(spark, sf_dir):
    df = notices(spark, sf_dir).select("type", "o_custkey", "dispatch_date")
    monthly = settled(sketches.count_sketches(df, ["type", F.trunc("dispatch_date", "MM").alias("month")], F.col("o_custkey"), "buyers"), "sketches")
    year = F.year("month").alias("year")
    calls, awards = (sketches.merged_counts(monthly.filter(F.col("type") == t), [year], "buyers").select(
        "year", F.col("buyers").alias(n), F.col("buyers_theta").alias(f"{n}_theta")) for t, n in (("cn", "calls"), ("can", "awards")))
    estimates = calls.join(awards, "year", "full_outer").withColumn("both", sketches.overlap(F.col("calls_theta"), F.col("awards_theta")))
    exact = df.groupBy(F.year("dispatch_date").alias("year"), "o_custkey").agg(
        F.bool_or(F.col("type") == "cn").alias("called"), F.bool_or(F.col("type") == "can").alias("awarded")).groupBy("year").agg(
        F.count_if("called").alias("calling"), F.count_if("awarded").alias("awarding"), F.count_if(F.col("called") & F.col("awarded")).alias("doing_both"))

    def within(estimate, count, error, base):
        # Three standard errors of the sketch, and rounding to a whole number.
        return F.abs(F.coalesce(F.col(estimate), F.lit(0)) - F.col(count)) <= 3 * error * F.col(base) + 0.5

    joined = exact.join(estimates, "year", "left").withColumn("either", F.col("calling") + F.col("awarding") - F.col("doing_both"))
    return joined.select("year", "calling", "awarding", "doing_both", within("calls", "calling", sketches.HLL_ERROR, "calling").alias("calling_within"),
                         within("awards", "awarding", sketches.HLL_ERROR, "awarding").alias("awarding_within"),
                         within("both", "doing_both", sketches.THETA_ERROR, "either").alias("both_within"))


@query("merged_lag_quantiles", """
SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS notices, TRUE AS med_within, TRUE AS p90_within
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) BETWEEN 0 AND 365 GROUP BY 1""")
def merged_lag_quantiles(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.to_date("o_orderdate").alias("start"))
    shipped = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.to_date("l_shipdate").alias("shipped"))
    lags = settled(orders.join(shipped, "o_orderkey").select("o_orderstatus", "start", F.datediff("shipped", "start").alias("lag"))
                   .filter(F.col("lag").between(0, 365)), "lags")
    monthly = settled(sketches.quantile_sketches(lags, ["o_orderstatus", F.trunc("start", "MM").alias("month")], F.col("lag"), "notices"), "sketches")
    yearly = sketches.merged_quantiles(monthly, [F.year("month").alias("year")], {"med": 0.5, "p90": 0.9}, "notices")
    # Where a quantile lies among all lags: equal lags share ranks, so it has a lowest and a highest one.
    placed = lags.withColumn("year", F.year("start")).join(yearly, "year").groupBy("year", "notices").agg(*(
        F.avg(test.cast("int")).alias(name) for c in ("med", "p90") for name, test in ((f"{c}_below", F.col("lag") < F.col(c)), (f"{c}_upto", F.col("lag") <= F.col(c)))))
    inside = {c: (F.col(f"{c}_below") <= p + sketches.RANK_ERROR) & (F.col(f"{c}_upto") >= p - sketches.RANK_ERROR) for c, p in (("med", 0.5), ("p90", 0.9))}
    return placed.select("year", "notices", *(test.alias(f"{c}_within") for c, test in inside.items()))


@query("stream_keep_last_state", """
SELECT CAST(date_trunc('month', ts) AS DATE) AS month, user_id, event_type, max_by(event_id, (ts, event_id)) AS event_id, max_by(value, (ts, event_id)) AS value
FROM events GROUP BY 1, 2, 3""")
def stream_keep_last_state(spark, sf_dir):
    work = scratch_path(spark, "keep-last-state")
    events = table(spark, sf_dir, "events").withColumns({"month": F.trunc("ts", "MM"), "ts": F.col("ts").cast("timestamp"), "arrival": F.col("event_id") % 3})
    cells = events.select("month", "user_id", "event_type", "ts", "event_id", "value", "arrival")
    # Three arrivals, each with rows of all times: two thirds of the corrections come late.
    for arrival in range(3):
        cells.filter(F.col("arrival") == arrival).drop("arrival").coalesce(1).write.mode("append").parquet(f"{work}/arrived")
    stream = jobs.file_stream(spark, cells.drop("arrival").schema, f"{work}/arrived", files_per_batch=1)
    keys = ["month", "user_id", "event_type"]
    jobs.log_updates(keyed.keep_last_in_state(stream, keys, ["ts", "event_id"], "ts", "400 days"), f"{work}/log", f"{work}/checkpoint")
    return jobs.latest_updates(spark, f"{work}/log", keys).select(*keys, "event_id", "value")


@query("stream_call_to_award", """
SELECT v.event_id, v.user_id, count(p.event_id) AS awards, min(date_diff('second', v.ts, p.ts)) AS first_after_seconds
FROM events v LEFT JOIN events p ON p.event_type = 'purchase' AND p.user_id = v.user_id AND p.ts BETWEEN v.ts AND v.ts + INTERVAL 2 DAY
WHERE v.event_type = 'view' GROUP BY 1, 2""")
def stream_call_to_award(spark, sf_dir):
    work = scratch_path(spark, "call-to-award")
    # The last arrival closes the history: one row a year later on both sides moves the watermarks past every open call.
    end = table(spark, sf_dir, "events").select((F.max(F.col("ts").cast("timestamp")) + F.expr("INTERVAL 365 DAYS")).alias("ts"))
    closing = end.select(F.lit(None).cast("bigint").alias("event_id"), "ts", F.lit(-1).cast("bigint").alias("user_id"), F.explode(F.array(F.lit("view"), F.lit("purchase"))).alias("event_type"))
    closing.coalesce(1).write.parquet(f"{work}/closing")
    columns = ["event_id", "ts", "user_id", "event_type"]
    arrived = _event_stream(spark, sf_dir).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    both = [arrived.unionByName(jobs.file_stream(spark, closing.select(*columns).schema, f"{work}/closing")) for _ in range(2)]
    calls = both[0].filter(F.col("event_type") == "view").select("event_id", "user_id", F.col("ts").alias("call_ts"))
    awards = both[1].filter(F.col("event_type") == "purchase").select(F.col("event_id").alias("award_id"), "user_id", F.col("ts").alias("award_ts"))
    joined = keyed.calls_with_awards(calls, awards, "user_id", "call_ts", "award_ts", "40 days", "2 DAYS")
    jobs.run_available(joined.writeStream.format("parquet").option("path", f"{work}/joined").outputMode("append"), f"{work}/checkpoint")
    met = spark.read.parquet(f"{work}/joined").filter(F.col("event_id").isNotNull())
    seconds = F.date_trunc("second", "award_ts").cast("bigint") - F.date_trunc("second", "call_ts").cast("bigint")
    return met.groupBy("event_id", "user_id").agg(F.count("award_id").alias("awards"), F.min(seconds).alias("first_after_seconds"))


@query("sql_functions", f"""
WITH {NOTICE_SQL},
ids AS (SELECT o_orderkey, CAST(1990 + o_orderkey % 30 AS VARCHAR) || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS export_id, value_eur FROM notice)
SELECT o_orderkey, CAST(CAST(substr(export_id, 5) AS BIGINT) AS VARCHAR) || '-' || left(export_id, 4) AS printed, left(export_id, 9) AS number,
       CASE WHEN value_eur BETWEEN 1000 AND 400000 THEN value_eur END AS value_ok FROM ids""")
def sql_functions(spark, sf_dir):
    sql.register_scalars(spark)
    export_id = F.concat((1990 + F.col("o_orderkey") % 30).cast("string"), F.lpad(F.col("o_custkey").cast("string"), 6, "0"))
    ids = notices(spark, sf_dir).select("o_orderkey", export_id.alias("export_id"), "value_eur")
    return spark.sql("""
        SELECT o_orderkey, notice_number(export_id) AS printed, register_number(concat('no ', export_id), :land) AS number,
               plausible_value(value_eur, :low, :high) AS value_ok FROM {ids}""", args={"land": "FRA", "low": 1000.0, "high": 400000.0}, ids=ids)


@query("sql_table_functions", f"""
WITH {NOTICE_SQL}
SELECT CAST(date_trunc('month', dispatch_date) AS DATE) AS month, n_name AS country, count(*) AS n, round(sum(value_eur), 2) AS total
FROM notice JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
WHERE type = 'can' AND CAST(date_trunc('month', dispatch_date) AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' GROUP BY 1, 2""")
def sql_table_functions(spark, sf_dir):
    buyer_notices(spark, sf_dir).select(F.col("dispatch_date").alias("day"), F.col("type").alias("kind"), "country", F.col("value_eur").cast("double").alias("value")).createOrReplaceTempView("notices")
    sql.register_tables(spark)
    return spark.sql("""
        SELECT month, country, n, round(total, 2) AS total FROM monthly_totals(:kind) WHERE month BETWEEN :first AND :last""",
                     args={"kind": "can", "first": "1995-01-01", "last": "1996-12-31"})


_PLAIN_SQL = "trim(regexp_replace(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g'))"


# A benchmark item's first two words are the condition of its tag.
@query("conditional_tags", f"""
WITH rules AS (SELECT 'T' || (item_id % 7) AS tag, array_to_string(string_split({_PLAIN_SQL.format('text')}, ' ')[1:2], ' ') AS phrase FROM benchmark),
titles AS (SELECT doc_id, lang, {_PLAIN_SQL.format('text')} AS plain FROM documents)
SELECT DISTINCT doc_id, tag FROM titles JOIN rules ON phrase <> '' AND ' ' || plain || ' ' LIKE '% ' || phrase || ' %'""")
def conditional_tags(spark, sf_dir):
    tag = F.concat(F.lit("T"), (F.col("item_id") % 7).cast("string")).alias("tag")
    first_two = F.substring_index(conditions.plain_words(F.col("text")), " ", 2).alias("phrase")
    rules = table(spark, sf_dir, "benchmark").select(tag, first_two)
    return conditions.met_conditions(table(spark, sf_dir, "documents"), rules, "doc_id", "text", "tag", "phrase")


# Sub-totals of a country's share: region, country and activity in one pass.
@query("share_rollup", """
WITH base AS (
  SELECT r_name AS region, n_name AS country, nullif(c_mktsegment, 'MACHINERY') AS activity, o_totalprice AS value,
         CASE WHEN o_orderdate < DATE '1998-01-01' THEN 'before' ELSE 'after' END AS period
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
rolled AS (
  SELECT period, region, country, activity, grouping_id(region, country, activity) AS level, count(*) AS n, sum(value) AS value
  FROM base GROUP BY period, ROLLUP (region, country, activity))
SELECT c.period, c.region, c.country, c.activity, CAST(c.level AS BIGINT) AS level, c.n, c.n / p.n AS share_of_parent
FROM rolled c LEFT JOIN rolled p ON c.period = p.period AND p.level = CASE c.level WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 3 THEN 7 END
  AND (c.level = 3 OR p.region = c.region) AND (c.level <> 0 OR p.country = c.country)""")
def share_rollup(spark, sf_dir):
    buyers = (table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
              .join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
              .select(F.col("c_custkey").alias("o_custkey"), F.col("r_name").alias("region"), F.col("n_name").alias("country"), F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("activity")))
    period = F.when(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp"), "before").otherwise("after").alias("period")
    base = table(spark, sf_dir, "orders").select("o_custkey", period).join(buyers, "o_custkey")
    return rolled_shares(base, ["period"], ["region", "country", "activity"])


@query("quarterly_lead", f"""
WITH {BUYER_NOTICE_SQL},
cells AS (SELECT country, CAST(date_trunc('quarter', dispatch_date) AS DATE) AS quarter, count(*) FILTER (WHERE type = 'cn') AS calls, count(*) FILTER (WHERE framework) AS frames
          FROM buyer_notice WHERE value_eur > 300000 GROUP BY 1, 2),
spans AS (SELECT country, unnest(generate_series(min(quarter), max(quarter), INTERVAL 3 MONTH))::DATE AS quarter FROM cells GROUP BY 1),
dense AS (SELECT country, quarter, coalesce(calls, 0) AS calls, coalesce(frames, 0) AS frames FROM spans LEFT JOIN cells USING (country, quarter)),
shifted AS (SELECT CAST(shift AS INTEGER) AS shift, frames, lag(calls, shift) OVER (PARTITION BY country, shift ORDER BY quarter) AS x FROM dense, range(0, 9) AS s(shift))
SELECT shift, count(x) AS n, round(corr(frames, x), 9) AS r FROM shifted WHERE x IS NOT NULL GROUP BY 1""")
def quarterly_lead(spark, sf_dir):
    df = buyer_notices(spark, sf_dir).filter(F.col("value_eur") > 300000)
    cells = df.groupBy("country", F.trunc("dispatch_date", "QUARTER").alias("quarter")).agg(
        F.count_if(F.col("type") == "cn").alias("calls"), F.count_if("framework").alias("frames"))
    found = shifted_correlation(settled(cells, "cells"), "country", "quarter", "calls", "frames", 8)
    return found.withColumn("r", F.round("r", 9))


@query("work_order", f"""
WITH months AS (SELECT CAST(unnest(generate_series(DATE '{FIRST_MONTH}', DATE '{LAST_MONTH}', INTERVAL 1 MONTH)) AS DATE) AS month),
done AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, c_nationkey AS nation FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 350000),
open AS (SELECT month, n_nationkey AS nation FROM months, nation EXCEPT SELECT month, nation FROM done)
SELECT month, nation, row_number() OVER (ORDER BY month DESC, nation) AS position FROM open""")
def work_order(spark, sf_dir):
    months = F.sequence(F.lit(LAST_MONTH).cast("date"), F.lit(FIRST_MONTH).cast("date"), F.expr("INTERVAL -1 MONTH"))
    grid = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.posexplode(months).alias("back", "month"))
    buyers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    counted = table(spark, sf_dir, "orders").filter(F.col("o_totalprice") > 350000).join(buyers, "o_custkey")
    still = quality.missing_cells(grid, counted.select(F.trunc("o_orderdate", "MM").alias("month"), "nation").distinct(), ["month", "nation"])
    return number_sorted(still, ["back", "nation"], "position").select("month", "nation", "position")


@query("clipped_texts", """
SELECT doc_id, left(text, 200) AS short_text, CAST(length(left(text, 200)) AS BIGINT) AS kept, md5(text) AS whole FROM documents""")
def clipped_texts(spark, sf_dir):
    short, whole = clipped(F.col("text"), 200), clipped(F.col("text"), None)
    return table(spark, sf_dir, "documents").select("doc_id", short.alias("short_text"), F.length(short).cast("bigint").alias("kept"), F.md5(whole.cast("binary")).alias("whole"))
