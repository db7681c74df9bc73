"""Fields and names: what JSON documents hold per month, names equal by collation, fill rates of winner fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticework.catalogue.quality import single_bid_cross_border
from noticework.catalogue.registry import ORACLES, query, table
from noticework.operators import drift
from noticework.operators.lookups import join_by_collation
from noticework.plans.reports import winner_fields
from noticework.session import settled

# Every event as a page whose fields change with its type and month; some pages are cut off.
_PAGES_SQL = """
pages_of AS (
  SELECT CAST(date_trunc('month', ts) AS DATE) AS month,
         CASE WHEN event_id % 97 = 0 THEN '{"id":' ELSE
         '{"id":' || event_id || ',"props":' || props
         || CASE WHEN event_type = 'purchase' THEN ',"lots":[{"no":1,"value":' || (event_id % 7) || '.5},{"no":2,"value":"n/a"},[true]]' ELSE '' END
         || CASE WHEN month(ts) % 2 = 0 THEN ',"note":null' ELSE ',"note":"' || event_type || '"' END || '}' END AS body FROM events)"""

_KINDS_SQL = _PAGES_SQL + """,
leaves AS (
  SELECT month, regexp_replace(t.fullkey, '\\[[0-9]+\\]', '[]', 'g') AS path, CAST(t.type AS VARCHAR) AS type
  FROM pages_of, LATERAL (SELECT unnest(CASE WHEN json_valid(body) THEN [1] ELSE [] END)) v, LATERAL json_tree(CASE WHEN json_valid(body) THEN body ELSE '{}' END) t),
kinds AS (
  SELECT month, path, CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'integer' WHEN 'UBIGINT' THEN 'integer'
         WHEN 'DOUBLE' THEN 'number' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'null' END AS kind, count(*) AS n FROM leaves GROUP BY 1, 2, 3
  UNION ALL SELECT month, '$', 'malformed', count(*) FROM pages_of WHERE NOT json_valid(body) GROUP BY 1)"""


def _kinds(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    event = F.col("event_id")
    lots = F.concat(F.lit(',"lots":[{"no":1,"value":'), event % 7, F.lit('.5},{"no":2,"value":"n/a"},[true]]'))
    note = F.when(F.month("ts") % 2 == 0, F.lit(',"note":null')).otherwise(F.concat(F.lit(',"note":"'), "event_type", F.lit('"')))
    whole = F.concat(F.lit('{"id":'), event, F.lit(',"props":'), "props", F.when(F.col("event_type") == "purchase", lots).otherwise(""), note, F.lit("}"))
    pages = e.select(F.trunc("ts", "MM").alias("month"), F.when(event % 97 == 0, '{"id":').otherwise(whole).alias("body"))
    return drift.field_kinds(pages, ["month"], "body")


@query("field_kinds", f"WITH {_KINDS_SQL}\nSELECT * FROM kinds")
def field_kinds(spark, sf_dir):
    return _kinds(spark, sf_dir)


@query("field_changes", f"""
WITH {_KINDS_SQL},
later AS (SELECT month, lead(month) OVER (ORDER BY month) AS next FROM (SELECT DISTINCT month FROM kinds)),
shifted AS (SELECT next AS month, path, kind, n AS n_before FROM kinds JOIN later USING (month) WHERE next IS NOT NULL)
SELECT month, path, kind, coalesce(n, 0) AS n, coalesce(n_before, 0) AS n_before,
       CASE WHEN n_before IS NULL THEN 'new' WHEN n IS NULL THEN 'gone' ELSE 'kept' END AS change
FROM kinds FULL JOIN shifted USING (month, path, kind)""")
def field_changes(spark, sf_dir):
    return drift.changes(settled(_kinds(spark, sf_dir), "kinds"), "month")


# One register writes names with accents and capitals, the other plainly.
@query("collated_names", """
WITH written AS (SELECT s_suppkey, translate(CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name) ELSE s_name END, 'uieE', 'üíéÉ') AS written FROM supplier)
SELECT s_suppkey, written, c_custkey, 'supplier#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS listed
FROM written JOIN customer ON lower(strip_accents(written)) = 'supplier#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0')""")
def collated_names(spark, sf_dir):
    name = F.when(F.col("s_suppkey") % 2 == 0, F.upper("s_name")).otherwise(F.col("s_name"))
    written = table(spark, sf_dir, "supplier").select("s_suppkey", F.translate(name, "uieE", "üíéÉ").alias("written"))
    listed = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("supplier#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("listed"))
    return join_by_collation(written, listed, "written", "listed")


@query("winner_field_matrix", f"""
SELECT 'can' AS type, country, year, field, share FROM ({ORACLES["single_bid_cross_border"]}) UNPIVOT INCLUDE NULLS (share FOR field IN (winner, winner_country, offers))""")
def winner_field_matrix(spark, sf_dir):
    return winner_fields(single_bid_cross_border(spark, sf_dir))
