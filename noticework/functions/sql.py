"""The column builders under names that SQL text can call, scalar and table-valued, registered once per session."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import SparkSession

from noticework.functions import codes


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _table_body(code: str, table: Mapping[str, str], default: str | None = None) -> str:
    """The CASE of ``codes.by_table``, from the same table."""
    cases = " ".join(f"WHEN {code} = {_quoted(k)} THEN {_quoted(v)}" for k, v in table.items())
    return f"CASE {cases} WHEN {code} IS NOT NULL THEN {_quoted(default)} END" if default else f"CASE {cases} END"


def _words_body(text: str, rules: Iterable[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({text}), {_quoted(word.lower())}) THEN {_quoted(label)}" for word, label in rules) + " END"


# Name, parameters, result and body of each function; bodies follow the builders of ``functions``.
SCALAR_FUNCTIONS = {
    "notice_number": ("export_id STRING", "STRING", r"""
        coalesce(CASE WHEN export_id RLIKE '^[0-9]{5,}$' THEN concat(CAST(try_cast(substring(export_id, 5) AS BIGINT) AS STRING), '-', left(export_id, 4)) END,
                 export_id)"""),
    "digits": ("raw STRING", "STRING", "regexp_replace(raw, '[^0-9]', '')"),
    "register_number": ("raw STRING, iso3 STRING", "STRING", """
        CASE WHEN iso3 = 'FRA' THEN left(regexp_replace(raw, '[^0-9]', ''), 9) ELSE regexp_replace(raw, '[^0-9]', '') END"""),
    "first_word": ("name STRING", "STRING", "substring_index(name, ' ', 1)"),
    "plausible_value": ("value DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE", "CASE WHEN value BETWEEN low AND high THEN value END"),
    "first_or_scalar": ("json STRING", "STRING", """
        coalesce(try_element_at(CASE WHEN startswith(ltrim(json), '[') AND endswith(rtrim(json), ']') THEN from_json(json, 'array<string>') END, 1),
                 CASE WHEN (CASE WHEN startswith(ltrim(json), '[') AND endswith(rtrim(json), ']') THEN from_json(json, 'array<string>') END) IS NULL THEN json END)"""),
    "activity_from_export": ("words STRING", "STRING", _words_body("words", codes.ACTIVITY_WORDS)),
    "buyer_type_from_export": ("code STRING", "STRING", _table_body("code", codes.EXPORT_BUYER_TYPES)),
    "procedure_from_export": ("code STRING", "STRING", _table_body("code", codes.EXPORT_PROCEDURES, "other")),
    "share_of": ("part DOUBLE, whole DOUBLE", "DOUBLE", "try_divide(part, whole)"),
}

# Table-valued functions over the view ``notices`` (day, kind, country, value).
TABLE_FUNCTIONS = {
    "notices_between": ("first DATE, last DATE", "day DATE, kind STRING, country STRING, value DOUBLE",
                        "SELECT day, kind, country, value FROM notices WHERE day BETWEEN first AND last"),
    "monthly_totals": ("wanted STRING", "month DATE, country STRING, n BIGINT, total DOUBLE", """
        SELECT CAST(trunc(day, 'MM') AS DATE), country, count(*), sum(value) FROM notices WHERE kind = wanted GROUP BY 1, 2"""),
}


def register_scalars(spark: SparkSession) -> None:
    """Scalar functions; calling it again changes nothing."""
    for name, (parameters, result, body) in SCALAR_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")


def register_tables(spark: SparkSession) -> None:
    """Table-valued functions; the view ``notices`` has to exist, and is looked up when a query runs."""
    for name, (parameters, result, body) in TABLE_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({result}) RETURN {body}")
