"""Operators on small edge-case tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from noticework.operators import entities, labels, lookups, ordering, quality, shares
from noticework.operators.winners import explode_winners

D = dt.date


def test_collapse_skips_unknown_first_rows(spark):
    df = spark.createDataFrame([(1, None, 1.0), (1, "2", 2.0), (2, None, None)], "id int, a string, v double")
    got = {r["id"]: r for r in entities.collapse_rows(df, ["id"], ["a"], {"v": F.sum("v")}).collect()}
    assert got[1]["a"] == "2" and got[1]["v"] == 3.0 and got[1]["n_rows"] == 2 and got[2]["a"] is None


def test_children_and_parents(spark):
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    child = spark.createDataFrame([(1, 5.0), (1, 7.0), (3, 1.0)], "id int, v double")
    got = {r["id"]: r for r in entities.rollup_children(parent, child, "id", {"n": F.count(F.lit(1)), "v": F.sum("v")}).collect()}
    assert got[1]["n"] == 2 and got[1]["v"] == 12.0 and got[2]["n"] is None
    assert entities.keep_children_of(child, parent, "id").count() == 2


def test_procedures_take_first_known_attributes(spark):
    rows = [("p", D(2020, 1, 1), "n1", None, 100.0, False), ("p", D(2020, 2, 1), "n2", "b", 100.0, True), ("p", D(2020, 3, 1), "n3", "a", 50.0, None), ("q", D(2021, 1, 1), "n4", "z", None, None)]
    df = spark.createDataFrame(rows, "proc string, d date, pub string, a string, v double, flag boolean")
    got = {r["proc"]: r for r in entities.to_procedures(df, ["proc"], "d", "pub", first=["a"], any_true=["flag"], distinct_sum={"v": F.col("v")}).collect()}
    assert got["p"]["a"] == "b" and got["p"]["first_date"] == D(2020, 1, 1) and got["p"]["notices"] == 3
    assert got["p"]["v"] == 150.0 and got["p"]["flag"] is True and got["q"]["v"] is None and got["q"]["flag"] is False


def test_keep_last_prefers_the_newest_row(spark):
    log = spark.createDataFrame([("m", 5, 1, 1), ("m", None, 2, 2), ("m", 7, 2, 3), ("k", None, 1, 4)], "cell string, n int, asof int, arrival int")
    got = {r["cell"]: r["n"] for r in ordering.keep_last(log, ["cell"], ["asof", "arrival"]).collect()}
    assert got == {"m": 7, "k": None}


def test_numbering_is_gapless_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("code")).repartition(7)
    by_code = ordering.number_sorted(df, ["code"]).orderBy("row_no").collect()
    assert [(r["code"], r["row_no"]) for r in by_code] == [(i, i + 1) for i in range(1000)]
    shuffled = ordering.number_shuffled(df, "code", 5).orderBy("row_no").collect()
    assert [r["row_no"] for r in shuffled] == list(range(1, 1001)) and [r["code"] for r in shuffled] != list(range(1000))


def test_stratified_sample_meets_quotas(spark):
    df = spark.range(300).select("id", F.when(F.col("id") < 200, "a").when(F.col("id") < 297, "b").otherwise("c").alias("s"))
    def draw():
        return ordering.stratified_sample(df, "s", {"a": 20, "b": 10}, 5, "id", seed=1)
    sizes = {r["s"]: r["n"] for r in draw().groupBy("s").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"a": 20, "b": 10, "c": 3}
    assert sorted(r["id"] for r in draw().collect()) == sorted(r["id"] for r in draw().collect())


def test_longest_prefix_wins(spark):
    stems = lookups.literal_table(spark, [("soft", "72"), ("cloud", "7231"), ("hard", "30")], "category string, stem string")
    codes = spark.createDataFrame([("72310000",), ("72000000",), ("30200000",), ("45000000",), (None,)], "cpv string")
    got = {r["cpv"]: r["category"] for r in lookups.prefix_class(codes, "cpv", stems, [2, 4], default="other").collect()}
    assert got == {"72310000": "cloud", "72000000": "soft", "30200000": "hard", "45000000": "other", None: "other"}


def test_currency_without_rate_stays_unknown(spark):
    rates = lookups.literal_table(spark, [("PLN", "2023-01", 4.0)], "currency string, month string, rate double")
    df = spark.createDataFrame([(8.0, "PLN", D(2023, 1, 5)), (8.0, "PLN", D(2023, 2, 5)), (8.0, "EUR", D(2023, 2, 5)), (8.0, None, D(2023, 1, 5))], "v double, cur string, d date")
    got = sorted((r["cur"] or "", str(r["d"]), r["value_base"]) for r in lookups.to_base_currency(df, rates, "v", "cur", F.col("d")).collect())
    assert got == [("", "2023-01-05", None), ("EUR", "2023-02-05", 8.0), ("PLN", "2023-01-05", 2.0), ("PLN", "2023-02-05", None)]


def test_index_needs_a_full_window(spark):
    months = [(D(2019 + i // 12, i % 12 + 1, 1), 10 + i) for i in range(13)]
    df = spark.createDataFrame([("x", m, n) for m, n in months], "g string, month date, n int")
    got = shares.index_series(df, "g", "month", "n", 2019).orderBy("month").collect()
    assert got[10]["idx_trailing"] is None and got[11]["idx_trailing"] == pytest.approx(100.0)
    assert got[0]["idx"] == pytest.approx(100 * 10 / 15.5)


def test_total_group_and_shares(spark):
    df = spark.createDataFrame([("a", 1, 2), ("b", 1, 6), ("a", 2, 0), ("b", 2, 0)], "g string, m int, n int")
    total = {(r["g"], r["m"]): r["n"] for r in shares.with_total_group(df, "g", ["m"], ["n"]).collect()}
    assert total[("ALL", 1)] == 8 and len(total) == 6
    got = {(r["g"], r["m"]): r["s"] for r in shares.with_shares(df, ["m"], {"n": "s"}).collect()}
    assert got[("a", 1)] == 0.25 and got[("a", 2)] is None
    assert sum(r["s"] for r in shares.with_grand_shares(df, {"n": "s"}).collect()) == pytest.approx(1.0)


def test_densify_fills_the_grid(spark):
    df = spark.createDataFrame([("a", 1, 0.5)], "c string, y int, s double")
    got = {(r["c"], r["y"]): r["s"] for r in shares.densify(df, ["c"], {"y": [1, 2]}, {"s": 0.0}).collect()}
    assert got == {("a", 1): 0.5, ("a", 2): 0.0}


def test_consensus_ties_and_bands(spark):
    votes = [("tie", "BD")] * 5 + [("tie", "04")] * 5 + [("one", "07")] * 10 + [("most", "01")] * 7 + [("most", "09")] * 3
    runs = spark.createDataFrame([(f"r{i}", c, v) for i, (c, v) in enumerate(votes)], "run string, code string, label string")
    got = {r["code"]: r for r in labels.consensus(runs).collect()}
    assert got["tie"]["consensus"] == "04" and got["tie"]["votes"] == "04:5 BD:5" and got["tie"]["agree"] == 0.5
    assert got["tie"]["band"] == "contested (<=50%)" and got["one"]["band"] == "unanimous" and got["most"]["band"] == "majority (50-75%)"


@pytest.mark.parametrize("a, b, factor", [
    ("oa_mini_v1_en", "oa_mini_v1_rep", labels.REPEAT), ("oa_mini_v1_en", "oa_mini_v1_shuf", labels.ORDER), ("gm_flash_v1_en", "gm_flash_v1_fr", labels.LANGUAGE),
    ("gm_flash_v1_en", "gm_flash_v2_en", labels.WORDING), ("oa_large_v1_en", "oa_mini_v1_en", labels.SIZE), ("gm_flash_v1_en", "oa_mini_v1_en", labels.FAMILY),
    ("oa_mini_v1_rep", "oa_mini_v1_shuf", labels.SEVERAL), ("gm_flash_v2_en", "oa_mini_v1_en", labels.SEVERAL)])
def test_differing_factor(value, a, b, factor):
    assert value(labels.differing_factor(F.lit(a), F.lit(b))) == factor


def test_pairwise_counts_only_common_codes(spark):
    runs = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("b", 1, "x"), ("b", 3, "y"), ("a", 4, "x"), ("b", 4, "z")], "run string, code int, label string")
    got = labels.pairwise_agreement(runs, ["a", "b"]).first()
    assert got["common"] == 2 and got["agreement"] == 0.5


def test_answers_in_every_shape(spark):
    item = '{"cpv": "45000000", "cofog_primary": "06", "notes": [1], "justification": ["a", "b"], "confidence": 0.5}'
    shapes = [(1, '{"items": [' + item + "]}"), (2, "[" + item + "]"), (3, '{"45000000": {"cofog_primary": "06", "justification": ["a", "b"], "confidence": 0.5}}'),
              (4, "```json\n[" + item + "]\n```"), (5, "not json"), (6, '[{"cpv": "99999999"}]'), (7, '{"items": {"45000000": {"cofog_primary": null}}}')]
    raw = spark.createDataFrame([(i, s, ["45000000"]) for i, s in shapes], "id int, answer string, codes array<string>")
    got = {r["id"]: r for r in labels.normalise_answers(raw, "answer", ["cpv", "cofog_primary", "justification", "confidence", "secondary"], asked="codes").collect()}
    assert set(got) == {1, 2, 3, 4, 7}
    assert all(got[i]["cofog_primary"] == "06" and got[i]["justification"] == "a; b" and got[i]["secondary"] is None for i in (1, 2, 3, 4))
    assert got[1]["confidence"] == "0.5" and got[7]["cofog_primary"] is None


def test_secondary_tags_need_votes(spark):
    df = spark.createDataFrame([("c", " 05.1 x")] * 4 + [("c", "04.5")] * 3 + [("d", "05.1")] * 3 + [("e", "  ")] * 9, "code string, secondary string")
    assert [tuple(r) for r in labels.secondary_tags(df, 4).collect()] == [("c", "05.1", 4)]


def test_winners_align_only_without_repeats(spark):
    rows = [("n1", '{"fra":["a","a","b"]}', '["FRA","DEU","ITA"]', "[1,2,3]", '["large"]'), ("n2", '{"fra":["a","b"],"deu":["c"]}', '["FRA","DEU"]', '["1","2"]', None),
            ("n3", '{"fra":["a","b"]}', '["FRA","FRA","FRA"]', '["1"]', "broken"), ("n4", "broken", None, None, None), ("n5", "{}", None, None, None)]
    df = spark.createDataFrame(rows, "id string, winner_names string, winner_countries string, winner_ids string, winner_sizes string")
    got = {(r["id"], r["winner"]): (r["n_winners"], r["winner_country"], r["winner_id"], r["winner_size"]) for r in explode_winners(df, ["id"]).collect()}
    assert got == {("n1", "a"): (2, None, None, None), ("n1", "b"): (2, None, None, None), ("n2", "a"): (2, "FRA", "1", None), ("n2", "b"): (2, "DEU", "2", None),
                   ("n3", "a"): (2, "FRA", None, None), ("n3", "b"): (2, "FRA", None, None)}


def test_reconcile_keeps_both_sides(spark):
    a = spark.createDataFrame([("m1", 3), ("m2", 1)], "m string, x long")
    b = spark.createDataFrame([("m2", 1), ("m3", 5)], "m string, y long")
    got = {r["m"]: r["difference"] for r in quality.reconcile(a, b, ["m"], "x", "y").collect()}
    assert got == {"m1": 3, "m2": 0, "m3": -5}


def test_validation_best_case(spark):
    df = spark.createDataFrame([("b", "06", "01"), ("b", "06", "06"), ("b", "01", "06")], "band string, human string, machine string")
    row = labels.agreement_by(labels.validation(df), "band").first()
    assert row["n"] == 3 and row["agreement"] == pytest.approx(1 / 3) and row["agreement_best_case"] == pytest.approx(2 / 3)
