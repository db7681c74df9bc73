"""Fill-in-the-middle samples against plain slicing, and read back."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from noticework.llm.infill import fill_in_middle, restored, unit_count

TEXTS = [None, "", "a", "😀", "\n", "\r\n x", "ab <P> c", "x <M>", "<S", "P>P><", "<" * 50, "$1 \\ $2 {3}", "Zoë 😀 語\n" * 700, "a" * 999, "a" * 1000, "a" * 1001,
         "word " * 40_000, "😀é" * 600_000]


def plain_sample(key, text, units=None):
    text = text or ""
    units = list(text) if units is None else units
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    head, middle, tail = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return len(units), "spm", a, b - a, f"<S>{tail}<P>{head}<M>{middle}"
    return len(units), "psm", a, b - a, f"<P>{head}<S>{tail}<M>{middle}"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 4)] + [(3, "same"), (3, "same"), (None, "no number")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("taken") for c in ("form", "infill_text", "infill_a", "other")}).repartition(8)


def test_samples_equal_plain_slices(docs):
    made = fill_in_middle(docs).withColumn("back", restored(F.col("output"), F.col("form")))
    rows = made.collect()
    assert len(rows) == 4 * len(TEXTS) + 3
    for r in rows:
        assert (r["n"], r["form"], r["prefix_units"], r["middle_units"], r["output"]) == plain_sample(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "") and r["other"] == r["infill_text"] == "taken"
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}


def test_units_may_be_words(spark):
    unit = r"(?:\S++\s*+)"
    texts = ["one", "one two  three\nfour", "w " * 2500, "x y z"]
    docs = spark.createDataFrame(list(enumerate(texts * 5)), "doc_id long, text string")
    for r in fill_in_middle(docs, unit=unit, prefix="cut_").collect():
        want = plain_sample(r["doc_id"], r["text"], re.findall(unit, r["text"]))
        assert (r["cut_n"], r["cut_form"], r["cut_prefix_units"], r["cut_middle_units"], r["cut_output"]) == want


def test_rates(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    counts = {r["form"]: r["count"] for r in fill_in_middle(docs).groupBy("form").count().collect()}
    assert abs(counts["plain"] - 400) < 80 and abs(counts["spm"] - 720) < 110
    assert fill_in_middle(docs, infill_percent=0).filter("form <> 'plain'").isEmpty()


def test_nothing(spark):
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_python(spark, docs):
    plan = fill_in_middle(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_unit_count_of_blocks(value):
    assert [value(unit_count(F.lit("é" * n))) for n in (0, 1, 999, 1000, 1001, 2500)] == [0, 1, 999, 1000, 1001, 2500]
