"""Column functions on the edge rows of real exports and pages."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from noticework.functions import codes, nested, text, values
from noticework.functions.dates import iso_day, mixed_day


@pytest.mark.parametrize("raw, day", [
    ("31/12/23", dt.date(2023, 12, 31)), ("05-JAN-16", dt.date(2016, 1, 5)), ("05-Jan-16", dt.date(2016, 1, 5)), ("1/2/23", dt.date(2023, 2, 1)),
    ("01/01/68", dt.date(2068, 1, 1)), ("01/01/69", dt.date(1969, 1, 1)), ("bad", None), ("32/01/20", None), (None, None)])
def test_mixed_day(value, raw, day):
    assert value(mixed_day(F.lit(raw).cast("string"))) == day


@pytest.mark.parametrize("raw, day", [("2024-05-02+02:00", dt.date(2024, 5, 2)), ("2024-05-02", dt.date(2024, 5, 2)), ("May", None)])
def test_iso_day(value, raw, day):
    assert value(iso_day(F.lit(raw))) == day


@pytest.mark.parametrize("raw, number", [("3.7", 4), ("2.5", 3), ("-2.5", -3), ("7", 7), ("1,000", None), ("", None)])
def test_whole_number_rounds_half_away(value, raw, number):
    assert value(values.whole_number(F.lit(raw))) == number


def test_plausible_value(value):
    def bounded(v, framework):
        return value(values.plausible_value(F.lit(v), F.lit(framework).cast("boolean")))
    assert bounded(5e3, None) == 5e3 and bounded(5e3, False) == 5e3
    assert bounded(5e3, True) is None and bounded(0.01, False) is None and bounded(1e9, False) is None


def test_share_of_nothing_is_unknown(value):
    assert value(values.share(F.lit(1), F.lit(0))) is None


def test_value_and_currency_stay_together(value):
    none = F.lit(None).cast("double")
    pair = value(values.first_known_pair((none, F.lit("EUR")), (F.lit(5.0), None), (F.lit(7.0), F.lit("PLN"))))
    assert pair["value"] == 5.0 and pair["currency"] is None


@pytest.mark.parametrize("raw, name", [
    ("Société Générale S.A.", "SOCIETE GENERALE"), ("S.A.", ""), ("SAS & Co.", ""), ("Müller GmbH & Co. KG", "MULLER"), ("Straße 7", "STRA E 7"),
    ("ŁÓDŹ sp. z o.o.", "ODZ"), ("  many   blanks ", "MANY BLANKS"), ("Ürün A.S.", "URUN"), (None, None)])
def test_company_name(value, raw, name):
    assert value(text.company_name(F.lit(raw).cast("string"))) == name


@pytest.mark.parametrize("prefix, raw, number", [
    ("FR", "12345678900012", "123456789"), ("FR", "FR12345678901", "345678901"), ("DE", "DE123", "123"), ("DE", "DEX1", "DEX1"), ("GB", "GB77", "77"), ("FR", "123456789", "123456789")])
def test_national_id(value, prefix, raw, number):
    assert value(text.national_id(F.lit(prefix), F.lit(raw))) == number


def test_register_numbers(value):
    assert value(text.register_prefix(F.lit("UK"))) == "GB"
    assert value(text.register_number(F.lit("FR 123.456.789.00012"), F.lit("FRA"))) == "123456789"
    assert value(text.usable_register_number(F.lit("12-34"), F.lit("DEU"))) is None
    assert value(text.embedded_national_id(F.lit("FR-12 ab"))) == "12AB"


def test_notice_number_drops_leading_zeros(value):
    assert value(text.notice_number(F.lit("2023263753"))) == "263753-2023"
    assert value(text.notice_number(F.lit("2016000042"))) == "42-2016"


@pytest.mark.parametrize("listed, home, abroad", [("AT", "AT", False), ("AT---DE", "AT", True), ("AT---AT", "AT", False), ("DE", "AT", True)])
def test_other_countries(value, listed, home, abroad):
    assert value(text.other_countries(F.lit(listed), F.lit(home))) is abroad


@pytest.mark.parametrize("raw, first", [('["a","b"]', "a"), ("s", "s"), ("[]", None), ("[2024] Works", "[2024] Works"), ("[null]", None), (None, None), ("12.5", "12.5")])
def test_first_or_scalar(value, raw, first):
    assert value(nested.first_or_scalar(F.lit(raw).cast("string"))) == first


def test_first_language_keeps_document_order(value):
    texts = nested.language_texts(F.lit('{"fra":["x"],"deu":["y"]}'))
    assert value(nested.first_language(texts)) == "fra"
    assert value(nested.first_or_scalar(nested.in_first_language(texts))) == "x"
    assert value(nested.language_texts(F.lit("plain"))) is None


@pytest.mark.parametrize("raw, framework", [("['none',null]", False), ("[]", None), ("['fa',null]", True), ("['none','fa']", True), (None, None), ("[null]", None)])
def test_flags_over_lists_ignore_unknown_elements(value, raw, framework):
    listed = nested.items(F.lit(None if raw is None else raw.replace("'", '"')).cast("string"))
    assert value(nested.any_other_than(listed, "none")) is framework


def test_total_of_texts(value):
    assert value(nested.total(F.array(F.lit("1.5"), F.lit("x"), F.lit(None)))) == 1.5
    assert value(nested.total(F.array(F.lit("x")))) is None


@pytest.mark.parametrize("label, activity", [
    ("Airport-related activities", "airport"), ("Port-related activities", "port"), ("Health", "health"), ("Production of gas and heat", "gas-heat"),
    ("Housing and community amenities", "hc-am"), ("Other", "other"), ("???", None), (None, None)])
def test_activity_rules_are_ordered(value, label, activity):
    assert value(codes.activity_from_export(F.lit(label).cast("string"))) == activity


def test_code_tables(value):
    assert value(codes.procedure_from_export(F.lit("NIC"))) == "neg-w-call"
    assert value(codes.procedure_from_export(F.lit("ZZZ"))) == "other"
    assert value(codes.procedure_from_page(F.lit(None).cast("string"))) is None
    assert value(codes.buyer_type_from_page(F.lit("body-pl-la"))) == "public-law-body"
    assert value(codes.buyer_type_from_page(F.lit("pub-undert-ra"))) == "utility"
    assert value(codes.buyer_type_from_page(F.lit("new-code"))) == "other"
    assert value(codes.owner_function(F.lit("rail"))) == "04"
    assert value(codes.owner_function(F.lit(None).cast("string"))) == "unresolved"


@pytest.mark.parametrize("hq, region", [(None, "Unknown HQ"), ("DEU", "Domestic parent"), ("FRA", "European parent"), ("USA", "US parent"), ("JPN", "Asian parent"), ("BRA", "Other parent")])
def test_headquarters_region(value, hq, region):
    assert value(codes.headquarters_region(F.lit(hq).cast("string"), F.lit("DEU"))) == region
