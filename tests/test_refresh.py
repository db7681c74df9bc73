"""Correction chains, merging sketches, keyed state, stream joins and SQL functions on edge cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from noticework.functions import codes, sql
from noticework.functions.nested import first_or_scalar
from noticework.functions.text import digits, first_word, notice_number, register_number
from noticework.operators import conditions
from noticework.operators.chains import chain_roots, latest_versions
from noticework.operators.shares import rolled_shares
from noticework.operators.sketches import QUANTILE_K, RANK_ERROR, count_sketches, merged_counts, merged_quantiles, overlap, quantile_sketches
from noticework.streaming import jobs, keyed


def plain_roots(links):
    """Root of each notice by walking; a circle's smallest notice where it goes round."""
    known, out = {n for n, _ in links if n is not None}, {}
    target = {}
    for n, c in links:
        if c is not None and (target.get(n) is None or c < target[n]):
            target[n] = c
    for n in known:
        path, at = [n], n
        while target.get(at) in known and target[at] not in path:
            at = target[at]
            path.append(at)
        if target.get(at) in known:
            circle = path[path.index(target[at]):]
            out[n] = (min(circle), True)
        else:
            out[n] = (at, False)
    return out


def test_chains_trees_circles_and_gaps(spark):
    links = [(i, i - 1 if i else None) for i in range(40)]
    links += [(100, 39), (101, 39), (102, 101), (200, 999), (300, 301), (301, 302), (302, 300), (303, 302), (304, 303), (400, 400), (401, 400),
              (500, None), (500, 5), (None, 3), (None, None)]
    rows = chain_roots(spark.createDataFrame(links, "n long, c long"), "n", "c").collect()
    assert {r["node"]: (r["root"], r["cyclic"]) for r in rows} == plain_roots(links) and len(rows) == len(plain_roots(links))


def test_latest_version_of_a_tree(spark):
    rows = [(1, None, 1), (2, 1, 5), (3, 1, 4), (4, 3, 5), (9, None, 2)]
    found = latest_versions(spark.createDataFrame(rows, "n long, c long, day int"), "n", "c", ["day"]).collect()
    assert {r["n"]: (r["first_version"], r["latest_version"], r["versions"]) for r in found} == {**{n: (1, 4, 4) for n in (1, 2, 3, 4)}, 9: (9, 9, 1)}


def test_no_links(spark):
    assert chain_roots(spark.createDataFrame([], "n long, c long"), "n", "c").count() == 0


def test_counts_merge_and_overlap(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("part"), (F.col("id") % 20_000).alias("who"))
    sketches = count_sketches(df.unionByName(df), ["part"], F.col("who"))
    whole = merged_counts(sketches, []).first()
    assert abs(whole["entities"] - 20_000) < 0.05 * 20_000
    sides = [merged_counts(count_sketches(spark.range(a, b).select("id"), [F.lit(1).alias("g")], F.col("id")), ["g"]) for a, b in ((0, 10_000), (4_000, 14_000))]
    both = sides[0].join(sides[1].withColumnsRenamed({"entities_theta": "other", "entities": "o"}), "g").select(overlap(F.col("entities_theta"), F.col("other")).alias("n")).first()["n"]
    assert abs(both - 6_000) < 0.05 * 14_000


def test_quantiles_merge(spark):
    df = spark.range(50_000).select((F.col("id") % 7).alias("month"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("v"))
    r = merged_quantiles(quantile_sketches(df, ["month"], F.col("v")), [], {"med": 0.5, "p90": 0.9}).first()
    assert r["measure"] == 25_000 and abs(r["med"] / 50_000 - 0.5) < RANK_ERROR and abs(r["p90"] / 50_000 - 0.9) < RANK_ERROR and QUANTILE_K == 200


def test_subtotals_differ_from_missing_members(spark):
    df = spark.createDataFrame([("EU", "FR", None), ("EU", "FR", "x"), ("EU", None, "x"), ("AS", "JP", "x")], "region string, country string, activity string")
    got = {(r["region"], r["country"], r["activity"], r["level"]): (r["n"], r["share_of_parent"]) for r in rolled_shares(df.withColumn("p", F.lit(1)), ["p"], ["region", "country", "activity"]).collect()}
    assert got["EU", "FR", None, 0] == (1, 0.5) and got["EU", "FR", None, 1] == (2, 2 / 3) and got["EU", None, None, 1] == (1, 1 / 3)
    assert got["EU", None, None, 3] == (3, 0.75) and got[None, None, None, 7] == (4, None) and got["EU", None, "x", 0] == (1, 1.0)


def test_state_keeps_the_last_row_and_expires(spark, tmp_path):
    schema = "cell string, ts timestamp, n int, v string"
    source, log, checkpoint = str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "checkpoint")

    def day(d):
        return dt.datetime(2024, 1, 1) + dt.timedelta(days=d)

    def run(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.file_stream(spark, spark.createDataFrame([], schema).schema, source)
        jobs.log_updates(keyed.keep_last_in_state(stream, ["cell"], ["ts", "n"], "ts", "10 days"), log, checkpoint)
        return {r["cell"]: r["v"] for r in jobs.latest_updates(spark, log, ["cell"]).collect()}

    assert run(("a", day(5), 1, "first"), ("a", day(5), 2, "second"), ("b", day(6), None, "only")) == {"a": "second", "b": "only"}
    # Restarted from the checkpoint: an older row changes nothing, an equal time with a larger number does.
    assert run(("a", day(4), 9, "older"), ("b", day(6), 0, "known number")) == {"a": "second", "b": "known number"}
    run(("c", day(60), 1, "far on"))
    run(("c", day(61), 1, "later"))
    # The watermark has passed a and b: their state is gone, and rows as old as that are dropped before they reach it.
    assert run(("a", day(7), 1, "too late"), ("c", day(62), 1, "last")) == {"a": "second", "b": "known number", "c": "last"}
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "last").load()
    assert [r["key"]["cell"] for r in held.select("key").collect()] == ["c"]


def test_calls_wait_for_awards(spark, tmp_path):
    def day(d):
        return dt.datetime(2024, 1, 1) + dt.timedelta(days=d)

    calls, awards = "k long, c timestamp", "k long, a timestamp"
    folders = {n: str(tmp_path / n) for n in ("calls", "awards", "out", "checkpoint")}

    def run(new_calls, new_awards):
        for name, schema, rows in (("calls", calls, new_calls), ("awards", awards, new_awards)):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folders[name])
        streams = [jobs.file_stream(spark, spark.createDataFrame([], schema).schema, folders[n]) for n, schema in (("calls", calls), ("awards", awards))]
        joined = keyed.calls_with_awards(*streams, "k", "c", "a", "5 days", "3 DAYS")
        jobs.run_available(joined.writeStream.format("parquet").option("path", folders["out"]).outputMode("append"), folders["checkpoint"])
        return sorted((r["k"], r["c"], r["a"]) for r in spark.read.parquet(folders["out"]).filter("a is not null").collect())

    assert run([(1, day(0)), (2, day(0)), (3, day(0))], [(1, day(1)), (2, day(4))]) == [(1, day(0), day(1))]
    # The award of call 3 arrives late, and is met all the same.
    assert (3, day(0), day(2)) in run([(9, day(1))], [(3, day(2))])
    run([(8, day(90))], [(8, day(90))])
    run([(8, day(91))], [(8, day(91))])
    rows = spark.read.parquet(folders["out"]).filter("k in (2, 9)").collect()
    assert sorted((r["k"], r["a"]) for r in rows) == [(2, None), (9, None)]


def test_harmonising_functions_equal_the_builders(functions):
    shapes = ["[\"a\", \"b\"]", "[]", "plain", "[2024] Works", "[1", " [3] ", None, "", *codes.EXPORT_BUYER_TYPES, *codes.EXPORT_PROCEDURES, *(f"x {w.upper()} y" for w, _ in codes.ACTIVITY_WORDS), "it's"]
    texts = functions.createDataFrame([(x,) for x in shapes], "x string")
    texts.createOrReplaceTempView("shapes_to_read")
    pairs = {"first_or_scalar(x)": first_or_scalar(F.col("x")), "activity_from_export(x)": codes.activity_from_export(F.col("x")),
             "buyer_type_from_export(x)": codes.buyer_type_from_export(F.col("x")), "procedure_from_export(x)": codes.procedure_from_export(F.col("x"))}
    assert functions.sql(f"SELECT {', '.join(pairs)} FROM shapes_to_read").collect() == texts.select(*pairs.values()).collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_conditional_tags_equal_a_search_of_every_phrase(spark, seed):
    rng = random.Random(seed)
    stock = ["school", "road", "works", "new", "the", "hospital", "of", "a"]
    texts = [(i, " ".join(rng.choice(stock) for _ in range(rng.randint(0, 12)))) for i in range(80)] + [(100, None), (101, ""), (102, "Road\n\tWORKS"), (102, "road works")]
    rules = [(i, " ".join(rng.choice(stock) for _ in range(rng.randint(1, 3)))) for i in range(25)] + [(50, "unheard of"), (51, ""), (52, None), (53, " Road  works "), (53, "school")]
    found = conditions.met_conditions(spark.createDataFrame(texts, "id long, title string"), spark.createDataFrame(rules, "rule long, phrase string"), "id", "title", "rule", "phrase").collect()
    def plain(x):
        return " ".join((x or "").lower().split())
    want = {(i, r) for i, t in texts for r, p in rules if plain(p) and f" {plain(p)} " in f" {plain(t)} "}
    assert {tuple(r) for r in found} == want and len(found) == len(want)


@pytest.fixture(scope="module")
def functions(spark):
    sql.register_scalars(spark)
    sql.register_scalars(spark)
    return spark


def test_sql_functions_equal_the_builders(functions):
    ids = functions.createDataFrame([("2023263753",), ("2023-1",), ("",), (None,), ("FR 123 456 789 00010",), ("20231",), ("99999999999999999999999999",)], "x string")
    ids.createOrReplaceTempView("ids_to_print")
    pairs = {"notice_number(x)": notice_number(F.col("x")), "digits(x)": digits(F.col("x")), "first_word(x)": first_word(F.col("x")),
             "register_number(x, 'FRA')": register_number(F.col("x"), F.lit("FRA")), "register_number(x, 'DEU')": register_number(F.col("x"), F.lit("DEU"))}
    called = functions.sql(f"SELECT {', '.join(pairs)} FROM ids_to_print").collect()
    assert [tuple(r) for r in called] == [tuple(r) for r in ids.select(*pairs.values()).collect()]


def test_table_functions(functions):
    functions.sql("SELECT DATE '2024-01-05' AS day, 'can' AS kind, 'FR' AS country, 2.0D AS value UNION ALL SELECT DATE '2024-02-01', 'cn', 'FR', 1.0D").createOrReplaceTempView("notices")
    sql.register_tables(functions)
    assert [tuple(r) for r in functions.sql("SELECT * FROM monthly_totals('can')").collect()] == [(dt.date(2024, 1, 1), "FR", 1, 2.0)]
    assert functions.sql("SELECT * FROM notices_between(DATE '2024-02-01', DATE '2024-03-01')").count() == 1
