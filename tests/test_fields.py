"""Field drift, names equal by collation, winner rows of the field matrix."""

import pytest

from noticework.functions.text import without_accents
from noticework.operators import drift
from noticework.operators.lookups import join_by_collation
from noticework.plans.reports import field_matrix, winner_fields
from pyspark.sql import functions as F


def test_kinds_of_odd_documents(spark):
    docs = [("m1", '{"a": 1, "b": [1.5, "x", {"c": null}], "d": true}'), ("m1", "[[1], []]"), ("m1", "{"), ("m1", None), ("m1", '"text"'), ("m1", '{"a": 1e3}'),
            (None, '{"a": 1}')]
    rows = {tuple(r) for r in drift.field_kinds(spark.createDataFrame(docs, "month string, body string"), ["month"], "body").collect()}
    assert rows == {
        ("m1", "$", "object", 2), ("m1", "$", "array", 1), ("m1", "$", "string", 1), ("m1", "$", "malformed", 1), ("m1", "$.a", "integer", 1), ("m1", "$.a", "number", 1),
        ("m1", "$.b", "array", 1), ("m1", "$.b[]", "number", 1), ("m1", "$.b[]", "string", 1), ("m1", "$.b[]", "object", 1), ("m1", "$.b[].c", "null", 1),
        ("m1", "$.d", "boolean", 1), ("m1", "$[]", "array", 2), ("m1", "$[][]", "integer", 1), (None, "$", "object", 1), (None, "$.a", "integer", 1)}


def test_documents_nested_too_deep_are_an_error(spark):
    deep = spark.createDataFrame([("m", "[" * 5 + "1" + "]" * 5)], "month string, body string")
    assert drift.field_kinds(deep, ["month"], "body", levels=6).count() == 6
    with pytest.raises(ValueError, match="nested"):
        drift.field_kinds(deep, ["month"], "body", levels=5)


def test_changes_skip_months_without_documents_and_empty_tables(spark):
    kinds = spark.createDataFrame([(1, "$.a", "string", 2), (1, "$.b", "null", 1), (3, "$.a", "string", 4), (3, "$.a", "integer", 1)], "month int, path string, kind string, n long")
    rows = {tuple(r) for r in drift.changes(kinds, "month").collect()}
    assert rows == {(1, "$.a", "string", 2, 0, "new"), (1, "$.b", "null", 1, 0, "new"), (3, "$.a", "string", 4, 2, "kept"), (3, "$.a", "integer", 1, 0, "new"), (3, "$.b", "null", 0, 1, "gone")}
    empty = spark.createDataFrame([], "month int, body string")
    assert drift.changes(drift.field_kinds(empty, ["month"], "body"), "month").count() == 0


def test_collation_next_to_the_table_of_accents(spark):
    left = spark.createDataFrame([("Müller",), ("STRASSE",), ("Ærø",), (None,), ("İzmir",), ("plain",)], "name string")
    right = spark.createDataFrame([("MULLER",), ("straße",), ("aerø",), (None,), ("izmir",), ("other",)], "listed string")
    found = {tuple(r) for r in join_by_collation(left, right, "name", "listed").collect()}
    plain = {tuple(r) for r in left.join(right, F.lower(without_accents(F.col("name"))) == F.lower(without_accents(F.col("listed")))).collect()}
    assert plain == {("Müller", "MULLER"), ("İzmir", "izmir")}
    # What the collation equates beyond the table.
    assert found - plain == {("STRASSE", "straße"), ("Ærø", "aerø")} and plain <= found


def test_winner_rows_join_the_field_matrix(spark):
    coverage = spark.createDataFrame([("can", 2024, "FR", 0.5, 0.6, 0.7, None)], "type string, year int, country string, value_raw double, nuts2 double, activity double, buyer_type double")
    winners = spark.createDataFrame([(2024, "FR", 0.9, 0.8), (2020, "FR", 0.1, 0.2)], "year int, country string, winner_country double, offers double")
    rows = {tuple(r) for r in field_matrix(coverage, [2024], winners).collect()}
    assert rows == {("can", "FR", 2024, f, s) for f, s in (("value_raw", 0.5), ("nuts2", 0.6), ("activity", 0.7), ("buyer_type", None), ("winner_country", 0.9), ("offers", 0.8))}
    assert winner_fields(winners.limit(0)).count() == 0
