"""The filter audit against a run of every order over every document."""

import re
from collections import Counter
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noticework.llm import audit
from noticework.llm.audit import failing_sets, interaction_audit, text_failures

SCHEMA = "doc_id long, text string, lang string"
LONG = " ".join(f"w{i}" for i in range(120))
TEXTS = [None, "", " \n", "short", LONG, "w " * 150, LONG.upper(), LONG + " #", "Über 語 😀", "A" * 20, "B " * 200 + "|", LONG + " x", "x" * 3_000_000 + " y"]


def plain_failures(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    return "".join(letter for letter, fails in zip("ABCD", (
        len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search("[#$%&*|]", text))), strict=True) if fails)


def plain_audit(docs, labels):
    smallest = {}
    for key, text, _ in docs:
        if key is not None:
            smallest[text or ""] = min(key, smallest.get(text or "", key))
    good, toxic = ({d for d, q, t in labels if (q, t)[i] == 1} for i in (0, 1))
    rows = []
    for key, text, lang in docs:
        repeat = key is not None and key > smallest[text or ""]
        rows.append((lang or "", plain_failures(text or "") + "E" * repeat, key in good and key is not None, key in toxic and key is not None))
    out = {}
    for part in {r[0] for r in rows}:
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            alive = [True] * len(rows)
            for step, letter in enumerate(order, 1):
                counts = Counter()
                for i, (p, fails, is_good, is_toxic) in enumerate(rows):
                    if p != part:
                        continue
                    hit = letter in fails
                    counts["redundant"] += hit and not alive[i]
                    counts["unique_fails"] += fails == letter
                    if hit and alive[i]:
                        counts["removed"] += 1
                        counts["good_lost"] += is_good
                        counts["toxic_lost"] += is_toxic
                        alive[i] = False
                    counts["kept"] += alive[i]
                total[letter] += counts["removed"]
                out[part, order, step] = [counts[c] for c in audit.COUNTS]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(total[order[step - 1]])
    return out


def found(spark, docs, labels):
    frame = spark.createDataFrame(docs, SCHEMA).withColumns({c: F.lit("taken") for c in ("fails", "digest", "key", "part", "good", "n", "first", "lowest")}).repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = interaction_audit(failing_sets(frame, marks)).collect()
    out = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in [*audit.COUNTS, "shapley"]] for r in rows}
    assert len(out) == len(rows)
    return out


def test_audit_equals_every_order_run(spark):
    docs = [(i, t, ("en", "de", None, "")[i % 4]) for i, t in enumerate(TEXTS * 3)] + [(0, None, "en"), (5, LONG, "fr"), (5, LONG, "fr"), (None, LONG, "en"), (None, "odd", None)]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 30)] + [(3, 0, 1), (4, None, None), (None, 1, 1), (999, 1, 1)]
    labels = [(d, q, None if t is None else int(t)) for d, q, t in labels]
    assert found(spark, docs, labels) == plain_audit(docs, labels)


def test_copies_of_one_text(spark):
    docs = [(i, LONG, "en") for i in range(400)] + [(i, f"{LONG} {i}", "en") for i in range(400, 500)]
    rows = found(spark, docs, [])
    assert rows["en", "EABCD", 1][:2] == [101, 399] and rows["en", "EABCD", 1][-1] == 399 * 120 and len(rows) == 600


def test_order_decides_what_a_step_removes(spark):
    rows = found(spark, [(1, "a #", "x"), (2, "a b", "x"), (3, LONG, "x")], [(1, 1, 0), (3, 1, 1)])
    assert rows["x", "DABCE", 1] == [2, 1, 0, 0, 1, 0, 60] and rows["x", "ADBCE", 2] == [1, 0, 1, 0, 0, 0, 60]
    assert sum(rows["x", "ADBCE", k][1] for k in range(1, 6)) == 2


def test_nothing(spark):
    assert found(spark, [], []) == {}


@pytest.mark.parametrize("text", TEXTS)
def test_text_failures(text):
    assert text_failures((text or "").encode()) == plain_failures(text or "")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB \n\t#é", max_size=400), st.integers(1, 9))
def test_stretches_change_nothing(text, stride):
    before, audit._STRIDE = audit._STRIDE, stride
    try:
        assert audit._word_counts(text.encode()) == (len(text.split()), len(set(text.split())))
    finally:
        audit._STRIDE = before


def test_plan_has_no_products(spark):
    docs, marks = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    plan = interaction_audit(failing_sets(docs, marks))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
