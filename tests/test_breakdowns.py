"""Reconciliation, breakdown and file forms on rows that are easy to get wrong."""

import datetime as dt

from pyspark.sql import functions as F

from noticework.functions.nested import is_json
from noticework.functions.text import notice_number, other_countries
from noticework.operators.ordering import extreme_rows, order_groups
from noticework.operators.shares import heat_table, stacked_shares
from noticework.plans import reports
from noticework.plans.register import match_coverage
from noticework.sources import readers, writers


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_reports_round_trip_quotes_and_blanks(spark, tmp_path):
    path = str(tmp_path / "r")
    writers.write_report(spark.createDataFrame([(1, '  a "quoted" one '), (2, "two\nlines"), (3, None), (4, "")], "n int, s string"), path, ["n"])
    assert rows(readers.read_text_csv_by_header(spark, path), "n") == [("1", '  a "quoted" one '), ("2", "two\nlines"), ("3", None), ("4", None)]


def test_page_reconciliation_takes_the_last_count(spark):
    api = spark.createDataFrame([("2024-01", "result")] * 3 + [("2024-02", "result")], "month string, form_type string")
    day = dt.date(2024, 1, 1)
    log = spark.createDataFrame([(day, "ALL", "result", 1, 9), (day, "ALL", "result", 2, 4), (day, "FRA", "result", 3, 1)],
                                "month date, country string, type string, asof int, n long")
    assert rows(reports.page_reconciliation(api, log), "month") == [("2024-01", "result", 3, 4, -1, 0.75)]


def test_stacked_shares_keep_the_largest_parts(spark):
    df = spark.createDataFrame([("01", "none", 50.0), ("01", "05", 30.0), ("01", "04", 15.0), ("01", "08", 5.0), ("02", "04", None)], "f string, s string, v double")
    found = {(f, s): round(x, 6) if x is not None else None for f, s, x in rows(stacked_shares(df, "f", "s", "v", "none", 1), "f", "s")}
    assert found == {("01", "05"): 0.3, ("01", "Other"): 0.2, ("02", "Other"): None}


def test_heat_table_is_cut_by_sums_and_leaves_unknown_columns_out(spark):
    df = spark.createDataFrame([("a", "x", 5.0), ("a", None, 9.0), ("b", "y", 4.0), ("b", "x", 1.0), ("c", "y", 1.0)], "r string, c string, v double")
    assert sorted((r["r"], r["c"]) for r in heat_table(df, "r", "c", "v", 2, 1).collect()) == [("a", "x"), ("b", "x")]


def test_extreme_rows_and_places(spark):
    df = spark.createDataFrame([("a", "x", 2.0), ("a", "y", 2.0), ("a", "z", None), ("b", "x", 7.0)], "g string, name string, v double")
    assert rows(extreme_rows(df, ["g"], "v", ["name"]), "g") == [("a", "x", 2.0), ("b", "x", 7.0)]
    assert rows(extreme_rows(df, ["g"], "v", ["name"], largest=True), "g") == [("a", "x", 2.0), ("b", "x", 7.0)]
    assert {(r["g"], r["position"]) for r in order_groups(df, "g", F.sum("v")).collect()} == {("a", 1), ("b", 2)}


def test_coverage_keeps_prefixes_without_a_match(spark):
    ids = spark.createDataFrame([("UK", "1", 5), ("UK", "2", 1), ("FR", "3", 2)], "country string, winner_id_norm string, awards long")
    matched = spark.createDataFrame([("GB", "1", 5)], "prefix string, natid string, awards long")
    assert rows(match_coverage(ids, matched), "prefix") == [("FR", 1, 2, None, None), ("GB", 2, 6, 1, 5)]


def test_origin_matrix_with_a_worldwide_country(spark):
    won = spark.createDataFrame([("acme", "US", "FR", 2, 60.0), ("other", "FR", "FR", 1, 40.0)],
                                "winner string, winner_country string, country string, awards long, value_eur double")
    matches = spark.createDataFrame([("acme", "USA", "Acme Inc")], "winner string, iso3 string, parent string")
    heads = spark.createDataFrame([("Acme Inc", "USA")], "parent string, hq_iso3 string")
    world = spark.createDataFrame([("US", "USA")], "iso2 string, iso3 string")
    found = reports.origin_matrix(won, matches, heads, countries=world).select("country", "hq", "value_eur", "share").collect()
    assert [tuple(r) for r in found] == [("FR", "USA", 60.0, 0.6)]


def test_spellings(value):
    assert value(notice_number(F.lit("2023263753"))) == "263753-2023"
    assert value(notice_number(F.lit("X-12345"))) == "X-12345"
    assert value(notice_number(F.lit("263753-2023"))) == "263753-2023"
    assert value(notice_number(F.lit(None).cast("string"))) is None
    assert value(other_countries(F.lit("AT---AT"), F.lit("AT"))) is False
    assert value(other_countries(F.lit("AT---DE"), F.lit("AT"))) is True
    assert value(is_json(F.lit('{"a": 1'))) is False
    assert value(is_json(F.lit("[1]"))) is True
    assert value(is_json(F.lit(None).cast("string"))) is None
