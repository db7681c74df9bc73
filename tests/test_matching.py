"""Similarity kernel, pair finding and match rules, against brute force."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from noticework.functions.meeting import combination_sizes

from noticework.functions.similarity import jaro_winkler_values
from noticework.functions.text import company_name
from noticework.operators import matching
from noticework.operators.skew import salted_join


def _mutated(rng, name):
    chars = list(name)
    for _ in range(rng.randint(0, 3)):
        place = rng.randrange(len(chars) + 1)
        kind = rng.random()
        if kind < 0.4:
            chars.insert(place, rng.choice("ABCDE 12"))
        elif kind < 0.7 and len(chars) > 1:
            chars.pop(min(place, len(chars) - 1))
        elif len(chars) > 1:
            place = min(place, len(chars) - 2)
            chars[place], chars[place + 1] = chars[place + 1], chars[place]
    return "".join(chars)


def _names(rng, n, words=("CENTRE", "SA", "SIEMENS", "CONSTRUCTIONGENERALE")):
    return sorted({" ".join([rng.choice(words), *("".join(rng.choice("ABCDEIORST") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(0, 3)))]) for _ in range(n)})


def test_kernel_equals_sql_engine():
    rng = random.Random(3)
    left = ["".join(rng.choice("ABCDEFGH 12") for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    right = [_mutated(rng, a) if rng.random() < 0.7 else rng.choice(left) for a in left]
    frame = pd.DataFrame({"a": left, "b": right})
    con = duckdb.connect()
    con.register("frame", frame)
    expected = con.sql("SELECT jaro_winkler_similarity(a, b) AS s FROM frame").df()["s"]
    got = jaro_winkler_values(frame["a"], frame["b"])
    both = frame["a"].str.len().gt(0) & frame["b"].str.len().gt(0)
    assert (expected[both] - got[both].astype(float)).abs().max() < 1e-12


def test_kernel_keeps_missing_names():
    got = jaro_winkler_values(pd.Series(["A", None]), pd.Series([None, "B"]))
    assert got.isna().all()


@pytest.mark.parametrize("usual_probes", [0, 100])
def test_pairs_equal_brute_force(spark, monkeypatch, usual_probes):
    # 0: every block counts as large; 100: the small ones meet directly.
    monkeypatch.setattr(matching, "_USUAL_PROBES", usual_probes)
    rng = random.Random(11)
    left = _names(rng, 300)
    right = sorted({_mutated(rng, n).strip() for n in rng.sample(left, 200)} | set(_names(rng, 100)))
    right = [" ".join(n.split()) for n in right if n.strip()]
    a = spark.createDataFrame([("FRA", n) for n in left], "iso3 string, name_norm string")
    b = spark.createDataFrame([("FRA", n) for n in set(right)], "iso3 string, name_norm string")
    con = duckdb.connect()
    con.register("a", pd.DataFrame({"n": left}))
    con.register("b", pd.DataFrame({"n": sorted(set(right))}))
    for threshold in (0.95, 0.85):
        expected = set(con.sql(f"""SELECT a.n, b.n FROM a, b WHERE split_part(a.n, ' ', 1) = split_part(b.n, ' ', 1) AND a.n <> b.n
                                   AND jaro_winkler_similarity(a.n, b.n) >= {threshold}""").fetchall())
        got = [(r["name_norm"], r["other_name_norm"]) for r in matching.similar_names(a, b, threshold).collect()]
        assert len(got) == len(set(got)) and set(got) == expected and expected


def test_repeated_letters_do_not_hide_pairs(spark):
    a = spark.createDataFrame([("X", "AB " + "A" * 12 + "BC")], "iso3 string, name_norm string")
    b = spark.createDataFrame([("X", "AB " + "A" * 12 + "CB")], "iso3 string, name_norm string")
    assert matching.similar_names(a, b, 0.95).count() == 1


@pytest.mark.parametrize("swap", [False, True])
def test_salted_join_keeps_every_pair(spark, swap):
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(600)], "k string, x int")
    right = spark.createDataFrame([("hot", i) for i in range(7)] + [(f"k{i}", i) for i in range(0, 600, 6)], "k string, y int")
    left, right = (right, left) if swap else (left, right)

    def total(joined):
        return joined.groupBy().agg(F.count("*").alias("n"), F.sum(F.col("x") * F.col("y")).alias("s")).first()
    assert total(left.join(right, "k")) == total(salted_join(left, right, ["k"], pairs_per_task=50))


def _register(spark):
    rows = [("Alpha", "FRA", "Alpha Travaux SA", "fr/123456789"), ("Beta", "FRA", "Beta Services", "fr/999999999"), ("Gamma", "FRA", "Beta Services SAS", "fr/888888888"),
            ("Delta", "FRA", "Electronique Delta France", "fr/777777777"), ("Nil", "FRA", "S.A.", "fr/1"), ("Tiny", "FRA", "Ab", "fr/2")]
    return matching.register_names(spark.createDataFrame(rows, "parent string, iso3 string, sub_name string, oc string"))


def test_match_rules(spark):
    rows = [("ALPHA TRAVAUX", "FRA", None, 10.0), ("Beta Services", "FRA", None, 10.0), ("S.A.", "FRA", None, 5.0), ("Autre Nom", "FRA", "123 456 789 00010", 5.0),
            *[("Electronique Delta Frances", "FRA", None, 1.0)] * 3, ("Electronique Delta Francee", "FRA", None, 1.0), ("Electronique Delta Franc", "DEU", None, 1e9)]
    awards = spark.createDataFrame(rows, "winner string, iso3 string, winner_id string, value double")
    winners = matching.winner_names(awards, "value")
    got = {(r["winner"], r["iso3"]): (r["parent"], r["how"]) for r in matching.match_all(winners, _register(spark)).collect()}
    # Two parents share a name, short names identify nobody; a floor on awards holds only where it is asked for.
    assert got == {("ALPHA TRAVAUX", "FRA"): ("Alpha", "exact"), ("Autre Nom", "FRA"): ("Alpha", "id"), ("Electronique Delta Frances", "FRA"): ("Delta", "fuzzy"),
                   ("Electronique Delta Francee", "FRA"): ("Delta", "fuzzy")}
    assert [r["winner"] for r in matching.match_fuzzy(winners, _register(spark), min_awards=3).collect()] == ["Electronique Delta Frances"]
    report = {r["how"]: r for r in matching.match_report(matching.match_all(winners, _register(spark)), winners).collect()}
    assert report["fuzzy"]["awards"] == 4 and abs(report["exact"]["share_of_awards"] - 1 / 8) < 1e-12
    assert winners.agg(F.max("value_capped")).first()[0] == 1e8


def test_exact_wins_over_number_and_near_name(spark):
    base = ("W", "FRA", 3, 1.0)
    def one(parent, sim, how):
        return spark.createDataFrame([(*base, parent, parent.lower(), sim, how)], "winner string, iso3 string, awards long, value_capped double, parent string, sub_name string, sim double, how string")
    assert matching.merge_matches(one("F", 0.99, "fuzzy"), one("I", 1.0, "id"), one("E", 1.0, "exact")).first()["parent"] == "E"
    assert matching.merge_matches(one("F", 0.99, "fuzzy"), one("I", 1.0, "id")).first()["parent"] == "I"


def test_normalised_names_are_idempotent(spark):
    names = spark.createDataFrame([("Société Générale S.A.",), ("ACME Co. Ltd",)], "n string")
    once = names.select(company_name(F.col("n")).alias("n"))
    assert once.collect() == once.select(company_name(F.col("n")).alias("n")).collect()


def test_meeting_points_lose_no_pair():
    """Two names whose shared characters reach the bound have a meeting point in common, whatever the size of a combination."""
    from collections import Counter

    from noticework.functions.meeting import name_probes
    from noticework.functions.similarity import overlap_factor

    rng = random.Random(8)
    ranks = {(c, k): rng.randrange(1000) for c in "ABCDEIORST 12" for k in range(1, 4)}
    met = 0
    for threshold in (0.95, 0.85):
        factor = overlap_factor(threshold)
        for a in _names(rng, 120):
            b = _mutated(rng, _mutated(rng, a))
            word = len(a.split(" ")[0])
            if b.split(" ")[0] != a.split(" ")[0]:
                continue
            common = sum((Counter(a) & Counter(b)).values())
            if common >= factor * len(a) * len(b) / (len(a) + len(b)) - 1e-9:
                met += 1
                for most in (1, 2, 3, 5):
                    assert set(name_probes(a, word, 7, most, factor, False, ranks)) & set(name_probes(b, word, 7, most, factor, True, ranks))
    assert met > 50


def test_fewer_pairs_meet_on_longer_combinations(spark):
    from noticework.functions.similarity import overlap_factor

    rng = random.Random(5)
    names = sorted({"CENTRE " + " ".join("".join(rng.choice("ABCDEFGHIKLMNOPRSTUV") for _ in range(rng.randint(3, 9))) for _ in range(3)) for _ in range(1200)})
    rng.shuffle(names)
    sides = [spark.createDataFrame([("X", "CENTRE", n) for n in part], "iso3 string, word string, name_norm string") for part in (names[:600], names[600:1200])]
    met = []
    for size in (1, 3):
        blocks = spark.createDataFrame([("X", "CENTRE", False, size)], "iso3 string, word string, direct boolean, size int")
        profiles = [matching._profiled(side, blocks, ["iso3", "word"]) for side in sides]
        met.append(matching.met_pairs(*profiles, overlap_factor(0.95), ["iso3", "word"]).select("id", "other_id").distinct().count())
    assert met[1] < met[0] / 3 and met[0] < 0.3 * 600 * 600


@pytest.mark.parametrize("most", [1.0, 1.7, 2.5, 3.3, 6.9])
def test_both_sides_combine_as_many_characters(most):
    for mine in range(3, 40):
        for partner in range(3, 40):
            ours, theirs = combination_sizes(mine, partner, 2, 1.7, most), combination_sizes(partner, mine, 2, 1.7, most)
            assert (ours is None) == (theirs is None)
            if ours:
                assert ours[1] == theirs[1] <= most + 1


def test_combinations_grow_little_by_little():
    lengths = [(a, b) for a in range(12, 30) for b in range(12, 30) if combination_sizes(a, b, 2, 1.7, 2.0)]
    means = [sum(combination_sizes(a, b, 2, 1.7, 2.0 + step / 10)[1] for a, b in lengths) / len(lengths) for step in range(11)]
    assert all(0 < later - before < 0.2 for before, later in zip(means, means[1:]))
