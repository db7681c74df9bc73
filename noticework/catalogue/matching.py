"""Winner names against a register, on names built from parts.

A line's part names the winner (``small ring Brand#12``) in the supplier's country; a part
names a register entry (``small ring Brand#37`` with its size) in the country of its brand.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from noticework.catalogue.registry import query, table
from noticework.functions.codes import headquarters_region
from noticework.functions.text import LEGAL_FORMS, LEGAL_PHRASES, NAME_FLOOR, company_name, embedded_national_id, national_id, register_prefix
from noticework.functions.values import weighted_mean
from noticework.operators import matching
from noticework.operators.labels import binned
from noticework.operators.shares import heat_table, with_grand_shares, with_shares
from noticework.session import dealt_out, settled

CAP = 60000.0


def norm_sql(expression: str) -> str:
    forms = "|".join([*LEGAL_PHRASES, *LEGAL_FORMS])
    words = f"regexp_replace(upper(strip_accents(replace({expression}, '.', ''))), '[^A-Z0-9]+', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({words}, '\\b({forms})\\b', ' ', 'g'), ' +', ' ', 'g'))"


# Own statement of the rules: all meetings of a firm with register entries in one list, a step number per
# method, and per firm the meeting with the smallest sort key.
_SIDES_SQL = f"""
WITH area AS (SELECT n_nationkey AS place, if(n_nationkey = 5, 'FRA', concat('N', n_nationkey)) AS iso3 FROM nation),
goods AS (SELECT p_partkey AS good, concat_ws(' ', p_name, p_brand) AS winner, 1000000 + p_partkey AS number FROM part),
firms AS (
  SELECT g.winner, a.iso3, min(g.number)::VARCHAR AS number, count(*) AS awards, sum(if(l.l_extendedprice > {CAP}, {CAP}, l.l_extendedprice)) AS value_capped
  FROM lineitem l, supplier s, area a, goods g WHERE l.l_suppkey = s.s_suppkey AND s.s_nationkey = a.place AND l.l_partkey = g.good GROUP BY ALL),
ours AS (SELECT *, {norm_sql('winner')} AS plain FROM firms WHERE length({norm_sql('winner')}) >= {NAME_FLOOR}),
listed AS (
  SELECT DISTINCT p_type AS parent, a.iso3, concat(p_name, ' Brand#', p_size) AS sub_name, (1000000 + p_partkey)::VARCHAR AS number
  FROM part JOIN area a ON concat('Brand#', a.place + 1) = p_brand),
entries AS (
  SELECT *, {norm_sql('sub_name')} AS plain FROM listed WHERE length({norm_sql('sub_name')}) >= {NAME_FLOOR}
  WINDOW same AS (PARTITION BY iso3, {norm_sql('sub_name')}) QUALIFY min(parent) OVER same = max(parent) OVER same)"""
_MEET = "SELECT o.winner, o.iso3, e.parent, e.sub_name, {step} AS step, {sim} AS sim FROM ours o JOIN entries e ON o.iso3 = e.iso3 AND {on}"
_BY_NAME_SQL = _MEET.format(step=0, sim="1.0::DOUBLE", on="o.plain = e.plain")
# Register numbers have seven digits here, so the French cut to nine changes nothing.
_BY_NUMBER_SQL = _MEET.format(step=1, sim="1.0::DOUBLE", on="o.number = e.number")
_NEAR_SQL = "SELECT * FROM (" + _MEET.format(
    step=2, sim="jaro_winkler_similarity(o.plain, e.plain)",
    on="regexp_extract(o.plain, '^[^ ]*') = regexp_extract(e.plain, '^[^ ]*') AND o.plain <> e.plain") + f") WHERE sim >= {matching.NEAR_NAME}"


def _matches_sql(*meetings: str) -> str:
    """``matches``: the first meeting of every firm by step, similarity and names."""
    return _SIDES_SQL + f""",
meetings AS ({' UNION ALL '.join(meetings)}),
firsts AS (SELECT winner, iso3, min((step, -sim, sub_name, parent)) AS best FROM meetings GROUP BY ALL),
matches AS (SELECT winner, iso3, awards, value_capped, best[4] AS parent, best[3] AS sub_name, -best[2] AS sim, ['exact', 'id', 'fuzzy'][best[1] + 1] AS how
            FROM firsts JOIN ours USING (winner, iso3))"""


_ALL_SQL = _matches_sql(_BY_NAME_SQL, _BY_NUMBER_SQL, _NEAR_SQL)
_SHOWN_SQL = " SELECT * REPLACE (round(value_capped, 2) AS value_capped, round(sim, 6) AS sim) FROM matches"


def _countries(spark, sf_dir):
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(key, F.when(key == 5, "FRA").otherwise(F.concat(F.lit("N"), key)).alias("iso3"))


def winners(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_name", "p_brand").alias("winner"))
    suppliers = (table(spark, sf_dir, "supplier").join(_countries(spark, sf_dir), F.col("n_nationkey") == F.col("s_nationkey"))
                 .select(F.col("s_suppkey").alias("l_suppkey"), "iso3"))
    awards = (table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.col("l_extendedprice").alias("value"),
                                                      F.concat(F.lit("R"), F.lit(1000000) + F.col("l_partkey")).alias("winner_id"))
              .join(parts, "l_partkey").join(suppliers, "l_suppkey"))
    return matching.winner_names(awards, "value", CAP)


def register(spark, sf_dir):
    home = F.substring("p_brand", 7, 5).cast("int") - 1
    parts = table(spark, sf_dir, "part").withColumn("n_nationkey", home).join(_countries(spark, sf_dir), "n_nationkey")
    return matching.register_names(parts.select(
        F.col("p_type").alias("parent"), "iso3", F.concat(F.col("p_name"), F.lit(" Brand#"), F.col("p_size")).alias("sub_name"),
        F.concat(F.lit("x/"), F.lit(1000000) + F.col("p_partkey")).alias("oc")))


def settled_sides(spark, sf_dir):
    """Both sides, computed once: every method reads them again."""
    return settled(winners(spark, sf_dir), "winners"), settled(register(spark, sf_dir), "register")


def _shown(matches):
    return matches.withColumns({"value_capped": F.round("value_capped", 2), "sim": F.round("sim", 6)})


@query("normalise_name", f"""
WITH t AS (SELECT 'supplier' AS kind, s_suppkey AS id, s_name AS txt FROM supplier UNION ALL SELECT 'customer', c_custkey, c_name FROM customer
           UNION ALL SELECT 'part', p_partkey, p_name FROM part UNION ALL SELECT 'document', doc_id, text FROM documents)
SELECT kind, id, md5(n) AS name_key, length(n) AS name_length, split_part(n, ' ', 1) AS first_word FROM (SELECT kind, id, {norm_sql('txt')} AS n FROM t)""")
def normalise_name(spark, sf_dir):
    sources = {"supplier": ("s_suppkey", "s_name"), "customer": ("c_custkey", "c_name"), "part": ("p_partkey", "p_name"), "document": ("doc_id", "text")}
    texts = None
    for kind, (key, text) in sources.items():
        name = "documents" if kind == "document" else kind
        part = dealt_out(table(spark, sf_dir, name)).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), company_name(F.col(text)).alias("n"))
        texts = part if texts is None else texts.unionByName(part)
    return texts.select("kind", "id", F.md5("n").alias("name_key"), F.length("n").cast("bigint").alias("name_length"),
                        F.substring_index("n", " ", 1).alias("first_word"))


@query("unambiguous_keys", """
SELECT p_partkey, p_name, p_size, p_brand FROM part
WHERE (p_name, p_size) IN (SELECT (p_name, p_size) FROM part GROUP BY p_name, p_size HAVING count(DISTINCT p_brand) = 1)""")
def unambiguous_keys(spark, sf_dir):
    return matching.unambiguous_names(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_brand"), ["p_name", "p_size"], "p_brand")


@query("match_exact", _matches_sql(_BY_NAME_SQL) + _SHOWN_SQL)
def match_exact(spark, sf_dir):
    return _shown(matching.match_exact(winners(spark, sf_dir), register(spark, sf_dir)))


@query("match_id", _matches_sql(_BY_NUMBER_SQL) + _SHOWN_SQL)
def match_id(spark, sf_dir):
    return _shown(matching.match_id(winners(spark, sf_dir), register(spark, sf_dir)))


@query("match_fuzzy", _matches_sql(_NEAR_SQL) + _SHOWN_SQL)
def match_fuzzy(spark, sf_dir):
    return _shown(matching.match_fuzzy(*settled_sides(spark, sf_dir)))


_FLOOR = f"ours AS (SELECT * FROM every_firm WHERE awards >= {matching.FUZZY_MIN_AWARDS} OR value_capped >= 150000)"


@query("match_fuzzy_floor", _matches_sql(_NEAR_SQL).replace("ours AS (", "every_firm AS (", 1).replace("listed AS (", _FLOOR + ",\nlisted AS (", 1) + _SHOWN_SQL)
def match_fuzzy_floor(spark, sf_dir):
    return _shown(matching.match_fuzzy(*settled_sides(spark, sf_dir), min_awards=matching.FUZZY_MIN_AWARDS, min_value=150000))


@query("match_priority", _ALL_SQL + _SHOWN_SQL)
def match_priority(spark, sf_dir):
    return _shown(matching.match_all(*settled_sides(spark, sf_dir)))


@query("match_report", _ALL_SQL + """,
whole AS (SELECT sum(awards) AS n, sum(value_capped) AS v FROM ours)
SELECT how, count(*) AS winners, CAST(sum(awards) AS BIGINT) AS awards, round(sum(value_capped), 2) AS value_capped, round(min(sim), 6) AS min_sim,
       sum(awards) / any_value(n) AS share_of_awards, round(sum(value_capped) / any_value(v), 6) AS share_of_value
FROM matches, whole GROUP BY how""")
def match_report(spark, sf_dir):
    known, entries = settled_sides(spark, sf_dir)
    report = matching.match_report(matching.match_all(known, entries), known)
    return report.withColumns({"value_capped": F.round("value_capped", 2), "min_sim": F.round("min_sim", 6), "share_of_value": F.round("share_of_value", 6)})


@query("match_precision", _ALL_SQL + """,
judged AS (SELECT any_value(m.how) AS how, bool_or(o.number = e.number) AS agrees
           FROM matches m NATURAL JOIN (SELECT winner, iso3, number FROM ours) o JOIN entries e ON (e.iso3, e.parent, e.sub_name) = (m.iso3, m.parent, m.sub_name)
           WHERE m.how <> 'id' GROUP BY m.winner, m.iso3)
SELECT how, count(*) AS checkable, count(*) FILTER (WHERE agrees) / count(*) AS ids_agree FROM judged GROUP BY how""")
def match_precision(spark, sf_dir):
    known, entries = settled_sides(spark, sf_dir)
    return matching.match_precision(matching.match_all(known, entries), known, entries)


@query("matched_share", _ALL_SQL + """,
flags AS (SELECT o.*, (winner, iso3) IN (SELECT (winner, iso3) FROM matches) AS hit FROM ours o)
SELECT iso3, CAST(sum(awards) AS BIGINT) AS awards, coalesce(sum(awards) FILTER (WHERE hit), 0) / sum(awards) AS awards_matched,
       round(coalesce(sum(value_capped) FILTER (WHERE hit), 0) / sum(value_capped), 6) AS value_matched
FROM flags GROUP BY iso3""")
def matched_share(spark, sf_dir):
    known, entries = settled_sides(spark, sf_dir)
    by_country = matching.matched_share(known, matching.match_all(known, entries))
    return by_country.withColumn("value_matched", F.round("value_matched", 6))


@query("top_parents", """
SELECT s_suppkey AS parent, n_name AS hq, count(*) AS awards, round(sum(l_extendedprice), 2) AS value
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2 ORDER BY awards DESC, parent LIMIT 15""")
def top_parents(spark, sf_dir):
    totals = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("parent")).agg(
        F.count(F.lit(1)).alias("awards"), F.round(F.sum("l_extendedprice"), 2).alias("value"))
    top = totals.orderBy(F.col("awards").desc(), "parent").limit(15)
    home = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("parent"), "s_nationkey")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("hq"))
    return top.join(home, "parent").join(nations, "s_nationkey", "left").select("parent", "hq", "awards", "value")


# --- where the money goes: buyer country against the supplier's headquarters -------------------

EUROPE = tuple(f"NATION_{n}" for n in range(10))
ASIA = tuple(f"NATION_{n}" for n in range(15, 20))
_HQ_SQL = """
WITH hq AS (SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN n_name END AS hq FROM supplier JOIN nation ON n_nationkey = s_nationkey),
split AS (SELECT o_orderkey, n_name AS home, CASE WHEN o_totalprice BETWEEN 1000 AND 400000 AND o_orderpriority <> '1-URGENT' THEN o_totalprice END AS value, awards
          FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN (SELECT l_orderkey, count(*) AS awards FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
won AS (SELECT home, hq, count(*) AS awards, sum(value / greatest(s.awards, 1)) AS v FROM lineitem JOIN split s ON s.o_orderkey = l_orderkey JOIN hq ON s_suppkey = l_suppkey GROUP BY 1, 2)"""


def won_value(spark, sf_dir):
    """Awards and split notice value by buyer country and headquarters."""
    nation = table(spark, sf_dir, "nation")
    hq = table(spark, sf_dir, "supplier").join(nation, F.col("n_nationkey") == F.col("s_nationkey")).select(
        F.col("s_suppkey").alias("l_suppkey"), F.when(F.col("s_acctbal") >= 0, F.col("n_name")).alias("hq"))
    buyers = table(spark, sf_dir, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select(
        F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("home"))
    value = F.when(F.col("o_totalprice").between(1000, 400000) & (F.col("o_orderpriority") != "1-URGENT"), F.col("o_totalprice"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", value.alias("value")).join(buyers, "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    per_supplier = lines.groupBy("o_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("won"))
    awards = per_supplier.groupBy("o_orderkey").agg(F.sum("won").alias("awards"))
    shared = per_supplier.join(orders.join(awards, "o_orderkey"), "o_orderkey").join(hq, "l_suppkey")
    each = matching.split_value(shared, F.col("value")) * F.col("won")
    return shared.groupBy("home", "hq").agg(F.sum("won").alias("awards"), F.sum(each).alias("v"))


_REGION_SQL = f"""CASE WHEN hq IS NULL THEN 'Unknown HQ' WHEN hq = home THEN 'Domestic parent' WHEN hq IN {EUROPE} THEN 'European parent'
       WHEN hq = 'NATION_10' THEN 'US parent' WHEN hq IN {ASIA} THEN 'Asian parent' ELSE 'Other parent' END"""


def _region():
    return headquarters_region(F.col("hq"), F.col("home"), EUROPE, "NATION_10", ASIA)


@query("origin_region", _HQ_SQL + f"""
SELECT {_REGION_SQL} AS region, CAST(sum(awards) AS BIGINT) AS awards, sum(awards) / (SELECT sum(awards) FROM won) AS share_awards FROM won GROUP BY 1""")
def origin_region(spark, sf_dir):
    by_region = won_value(spark, sf_dir).groupBy(_region().alias("region")).agg(F.sum("awards").alias("awards"))
    return with_grand_shares(by_region, {"awards": "share_awards"})


@query("split_value_share", _HQ_SQL + f""",
r AS (SELECT home, {_REGION_SQL} AS region, CAST(sum(awards) AS BIGINT) AS awards, round(sum(v)) AS v FROM won GROUP BY 1, 2)
SELECT *, round(v / sum(v) OVER (PARTITION BY home), 6) AS share, awards / sum(awards) OVER (PARTITION BY home) AS share_n FROM r""")
def split_value_share(spark, sf_dir):
    by_region = won_value(spark, sf_dir).groupBy("home", _region().alias("region")).agg(F.sum("awards").alias("awards"), F.round(F.sum("v")).alias("v"))
    shared = with_shares(by_region, ["home"], {"v": "share", "awards": "share_n"})
    return shared.withColumn("share", F.round("share", 6))


@query("origin_matrix", _HQ_SQL + """,
h AS (SELECT home, hq, round(v) AS v, round(v / sum(v) OVER (PARTITION BY home), 6) AS share FROM won),
rows20 AS (SELECT home FROM h GROUP BY 1 ORDER BY sum(v) DESC, home LIMIT 20),
cols10 AS (SELECT hq FROM h WHERE hq IS NOT NULL GROUP BY 1 ORDER BY sum(v) DESC, hq LIMIT 10)
SELECT * FROM h WHERE home IN (SELECT home FROM rows20) AND hq IN (SELECT hq FROM cols10)""")
def origin_matrix(spark, sf_dir):
    won = won_value(spark, sf_dir)
    cells = with_shares(won, ["home"], {"v": "share"}).select("home", "hq", F.round("v").alias("v"), F.round("share", 6).alias("share"))
    return heat_table(cells, "home", "hq", "v", rows=20, columns=10).select("home", "hq", "v", "share")


# --- register numbers ------------------------------------------------------------------------

SIZES = ((9.0, "micro"), (49.0, "small"), (249.0, "medium"), (float("inf"), "large"))


@query("register_id_match", """
WITH t AS (SELECT l_suppkey, l_returnflag, count(*) AS awards FROM lineitem GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN s_nationkey < 10 THEN 'FR' WHEN s_nationkey < 18 THEN 'GB' ELSE 'DE' END AS prefix, s_acctbal / 30 AS employees FROM supplier)
SELECT prefix, CASE WHEN employees <= 9 THEN 'micro' WHEN employees <= 49 THEN 'small' WHEN employees <= 249 THEN 'medium' ELSE 'large' END AS size,
       count(*) AS winners, CAST(sum(awards) AS BIGINT) AS awards FROM t JOIN s ON s_suppkey = l_suppkey GROUP BY 1, 2""")
def register_id_match(spark, sf_dir):
    nation = F.col("s_nationkey")
    country = F.when(nation < 10, "FR").when(nation < 18, "UK").otherwise("DE")
    supplier = table(spark, sf_dir, "supplier")
    companies = supplier.select(
        F.concat(register_prefix(country), F.lit("-"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("company_id"), (F.col("s_acctbal") / 30).alias("employees"))
    companies = companies.select(F.left("company_id", F.lit(2)).alias("prefix"), embedded_national_id(F.col("company_id")).alias("natid"),
                                 binned(F.col("employees"), SIZES).alias("size"))
    number = F.lpad(F.col("s_suppkey").cast("string"), 9, "0")
    spelled = (F.when((country == "FR") & (F.col("l_returnflag") == "A"), F.concat(number, F.lit("00012")))
               .when((country == "FR") & (F.col("l_returnflag") == "N"), F.concat(F.lit("FR77"), number))
               .when(F.col("l_returnflag") == "R", number).otherwise(F.concat(register_prefix(country), number)))
    counted = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey"), "l_returnflag").agg(F.count(F.lit(1)).alias("awards"))
    ids = counted.join(supplier, "s_suppkey").select(register_prefix(country).alias("prefix"), spelled.alias("raw"), "awards")
    ids = ids.withColumn("natid", national_id(F.col("prefix"), F.col("raw")))
    return ids.join(companies, ["prefix", "natid"]).groupBy("prefix", "size").agg(F.count(F.lit(1)).alias("winners"), F.sum("awards").alias("awards"))


@query("size_shares", """
SELECT c_mktsegment, count(*) AS n, round(CASE WHEN sum(w) <> 0 THEN sum(x * w) / sum(w) END, 6) AS weighted
FROM (SELECT c_mktsegment, c_acctbal AS x, CAST(c_nationkey AS DOUBLE) AS w FROM customer) GROUP BY 1""")
def size_shares(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.round(weighted_mean(F.col("c_acctbal"), F.col("c_nationkey")), 6).alias("weighted"))
