"""Lists given by the caller never make rows vanish without a word."""

import pytest
from pyspark.sql import functions as F

from noticework.operators import labels, lookups, matching, shares
from noticework.plans import register, reports


def test_winners_from_anywhere_match(spark):
    award = spark.createDataFrame([("Omega Motors Inc", "US", None, 5.0), ("Alpha Travaux", "FR", None, 5.0)],
                                  "winner string, winner_country string, winner_id string, award_value_eur_fin1 double")
    entries = spark.createDataFrame([("Omega", "USA", "Omega Motors", "us/1"), ("Alpha", "FRA", "Alpha Travaux", "fr/2")], "parent string, iso3 string, sub_name string, oc string")
    countries = spark.createDataFrame([("US", "USA"), ("US", "USA"), ("FR", "FRA"), ("JP", "JPN")], "iso2 string, iso3 string")
    _, _, matches = register.match_winners(award, entries, countries)
    assert {(r["parent"], r["iso3"]) for r in matches.collect()} == {("Omega", "USA"), ("Alpha", "FRA")}
    won = spark.createDataFrame([("Omega Motors Inc", "US", "DE", 1, 5.0)], "winner string, winner_country string, country string, awards long, value_eur double")
    homes = spark.createDataFrame([("Omega", "USA")], "parent string, hq_iso3 string")
    assert reports.multinational_shares(won, matches, homes, countries=countries).first()["region"] == "US parent"


def test_unlisted_stem_length_is_an_error(spark):
    codes = spark.createDataFrame([("48123",)], "cpv string")
    stems = spark.createDataFrame([("481", "Software"), ("48", "IT")], "stem string, category string")
    assert lookups.prefix_class(codes, "cpv", stems, [2, 3]).first()["category"] == "Software"
    with pytest.raises(Exception, match="unlisted length"):
        lookups.prefix_class(codes, "cpv", stems, [2, 4]).collect()


def test_rows_outside_a_grid_stay(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 9, 0.7)], "c string, y int, s double")
    got = {(r["c"], r["y"]): r["s"] for r in shares.densify(df, ["c"], {"y": [1, 2]}, {"s": 0.0}).collect()}
    assert got == {("a", 1): 0.5, ("a", 2): 0.0, ("a", 9): 0.7}


def test_unlisted_pivot_value_and_run_are_errors(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 3, 7)], "c string, y int, n int")
    assert shares.wide(df, ["c"], "y", [1, 3], {"n": F.max("n")}).first()["3_n"] == 7
    with pytest.raises(Exception, match="unlisted value: 3"):
        shares.wide(df, ["c"], "y", [1, 2], {"n": F.max("n")}).collect()
    runs = spark.createDataFrame([("r1", "c", "x"), ("r2", "c", "x")], "run string, code string, label string")
    with pytest.raises(Exception, match="run not listed: r2"):
        labels.pairwise_agreement(runs, ["r1", "r3"]).collect()


def test_precision_counts_a_match_once(spark):
    winners = spark.createDataFrame([("W", "X", "1234567")], "winner string, iso3 string, winner_id string")
    entries = spark.createDataFrame([("P", "X", "S", "7654321"), ("P", "X", "S", "1234567"), ("Q", "X", "S", "9999999")], "parent string, iso3 string, sub_name string, oc_digits string")
    matches = spark.createDataFrame([("W", "X", "P", "S", "exact")], "winner string, iso3 string, parent string, sub_name string, how string")
    assert matching.match_precision(matches, winners, entries).first()[1:] == (1, 1.0)
