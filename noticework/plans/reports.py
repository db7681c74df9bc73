"""Reports on the product tables; each returns a small aggregated DataFrame."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticework.functions import codes
from noticework.functions.dates import month_key, month_start
from noticework.functions.text import mentions, other_countries
from noticework.functions.values import filled_share, magnitude, number, plausible_value, share, yes_share
from noticework.operators import labels, matching, quality, shares
from noticework.operators.correlation import log_correlation, log_correlation_by_window
from noticework.operators.entities import monthly_panel, procedures_per_month, to_procedures
from noticework.operators.lookups import prefix_class, resolve_function
from noticework.operators.ordering import keep_last
from noticework.plans.register import with_country

HISTORY_START = dt.date(2016, 1, 1)

# Words that mark green and gender-equality purchases, in the languages of the notices.
GREEN_WORDS = ("électrique", "electric", "elektro", "eléctric", "elettric", "elektryczn", "photovolta", "fotovolta", "solar", "solaire",
               "wärmepumpe", "heat pump", "pompe à chaleur", "isolation thermique", "energy efficien", "efficacité énergétique",
               "energieeffizien", "eficiencia energética", "efficienza energetica")
GENDER_WORDS = ("gender equality", "gender mainstreaming", "égalité femmes", "égalité professionnelle", "égalité des sexes", "gleichstellung",
                "igualdad de género", "parità di genere", "równość płci", "równości płci", "gendergelijkheid")

# Function divisions without buyer-dependent leftovers, expenditure items compared with.
EXPENDITURE_ITEMS = ("P2", "P51G")
# Headquarters missing from the register.
KNOWN_HEADQUARTERS = {"Compagnie de Saint Gobain SA": "FRA", "GSK plc": "GBR", "Compass Group PLC": "GBR", "GE Vernova Inc": "USA",
                      "Canon Inc": "JPN", "AbbVie Inc": "USA"}


def _procedure() -> Column:
    return F.coalesce("procedure_id", "pub_number")


def counted_notices(notice_all: DataFrame, last: dt.date | None = None, first: dt.date = HISTORY_START) -> DataFrame:
    """Notices dispatched from ``first`` on (to ``last``, if given) with a known country, their procedure and plausible value."""
    kept = notice_all.filter((F.col("dispatch_date") >= F.lit(first)) & F.col("country").isNotNull())
    if last is not None:
        kept = kept.filter(F.col("dispatch_date") <= F.lit(last))
    return kept.withColumns({"proc": _procedure(), "v": plausible_value(F.col("value_eur"), F.col("framework"))})


# --- coverage and quality -----------------------------------------------------------------------

def export_coverage(raw: DataFrame, kind: str, identity: str, value: str) -> DataFrame:
    """Distinct notices and shares per year and country of one export type.

    A notice counts once, in its first year, even if several yearly files hold it.
    """
    per_notice = raw.groupBy(F.col(identity).alias("id")).agg(
        F.min("YEAR").alias("year"), F.min("ISO_COUNTRY_CODE").alias("country"), F.count(F.lit(1)).alias("n_rows"), F.bool_or(number(F.col(value)) > 0).alias("has_value"),
        F.bool_or(F.col("B_FRA_AGREEMENT") == "Y").alias("framework"), F.bool_or(F.length("TAL_LOCATION_NUTS") >= 4).alias("nuts2"))
    return per_notice.groupBy(F.lit(kind).alias("type"), "year", "country").agg(
        F.count(F.lit(1)).alias("notices"), F.avg("n_rows").alias("rows_per_notice"), yes_share(F.col("has_value")).alias("value_share"),
        yes_share(F.col("framework")).alias("framework_share"), yes_share(F.col("nuts2")).alias("nuts2_share"))


# Types of the count log that are calls (fixed values).
CALL_TYPES = ["cn", "competition"]


def month_profile(cn: DataFrame, counts: DataFrame, countries: Mapping[str, str]) -> DataFrame:
    """Distinct export calls per month next to the counted series, overall and for some countries.

    The counts are a log: the last row of a cell replaces the earlier ones, and only calls are compared.
    """
    ours = cn.groupBy(month_key(F.col("dispatch_date")).alias("month")).agg(
        F.count_distinct("id").alias("export_ALL"),
        *[F.count_distinct(F.when(F.col("country") == iso2, F.col("id"))).alias(f"export_{iso2}") for iso2 in countries])
    wanted = ["ALL", *countries.values()]
    calls = keep_last(counts.filter(F.col("type").isin(CALL_TYPES)), ["month", "country", "type"], ["asof"])
    theirs = calls.filter(F.col("country").isin(*wanted)).groupBy(month_key(F.col("month")).alias("month")).pivot("country", wanted).agg(F.sum("n"))
    return quality.reconcile(ours, theirs, ["month"], "export_ALL", "ALL")


def page_reconciliation(api: DataFrame, counts: DataFrame) -> DataFrame:
    """Parsed notices per month and form next to the logged count of all countries, where both are known."""
    parsed = api.groupBy("month", "form_type").agg(F.count(F.lit(1)).alias("parsed"))
    latest = keep_last(counts.filter(F.col("country") == "ALL"), ["month", "type"], ["asof"])
    logged = latest.select(month_key(F.col("month")).alias("month"), F.col("type").alias("form_type"), F.col("n").alias("counted"))
    return quality.reconcile(parsed, logged, ["month", "form_type"], "parsed", "counted", how="inner")


def page_profile(api: DataFrame) -> DataFrame:
    """Notices and fill rates of parsed pages per type."""
    value = F.coalesce("total_value", "est_value", "est_value_lots")
    filled = {"activity": "main_activity", "legal_type": "buyer_legal_type", "procedure_id": "procedure_id", "description": "description",
              "winner_country": "winner_country", "award_date": "award_date"}
    return api.groupBy("type").agg(
        F.count(F.lit(1)).alias("notices"), F.min("pub_date").alias("first_day"), F.max("pub_date").alias("last_day"), F.count_distinct("country").alias("countries"),
        filled_share(value).alias("has_value"), yes_share(F.col("framework")).alias("framework"), yes_share(F.col("eu_funds")).alias("eu_funds"),
        *(filled_share(F.col(c)).alias(f"has_{name}") for name, c in filled.items()))


def field_coverage(notice_all: DataFrame) -> DataFrame:
    value_ok = F.avg(F.coalesce(plausible_value(F.col("value_eur")).isNotNull(), F.lit(False)).cast("int"))
    return quality.coverage(counted_notices(notice_all), ["type", F.year("dispatch_date").alias("year"), "country"], F.col("proc"),
                            filled=["nuts2", "activity", "buyer_type", "cpv"], true=["framework", "eu_funds"],
                            extra={"value_raw": filled_share(F.col("value_eur")), "value_ok": value_ok})


def field_matrix(coverage: DataFrame, years: Sequence[int], winners: DataFrame | None = None) -> DataFrame:
    """Fill rates in long form, for heat tables of two periods.

    ``winners`` (year, country and fill rates of winner fields, as ``page_winners`` or ``export_winners`` give them) adds rows to
    the award notices.
    """
    matrix = shares.long(coverage.filter(F.col("year").isin(*years)), ["type", "country", "year"], ["value_raw", "nuts2", "activity", "buyer_type"], "field", "share")
    if winners is None:
        return matrix
    return matrix.unionByName(winner_fields(winners.filter(F.col("year").isin(*years))))


def winner_fields(winners: DataFrame) -> DataFrame:
    """The fill rates of winner and offer fields that ``winners`` has, in long form."""
    rates = winners.withColumn("type", F.lit("can"))
    fields = [c for c in ("winner", "winner_country", "offers") if c in winners.columns]
    return shares.long(rates, ["type", "country", "year"], fields, "field", "share")


def monthly_values(notice_all: DataFrame) -> DataFrame:
    dated = notice_all.withColumn("day", F.coalesce("dispatch_date", "pub_date"))
    return monthly_panel(dated, "day", ["source", "type", "country", "contract_type"], "value_eur")


def monthly_procedures(notice_all: DataFrame) -> DataFrame:
    procedures = to_procedures(counted_notices(notice_all), ["type", "proc"], "dispatch_date", "pub_number", country="country")
    return procedures_per_month(procedures, ["type", "country"])


def export_winners(award: DataFrame, notice_can: DataFrame) -> DataFrame:
    notices = notice_can.select(F.col("id").cast("string").alias("id"), "country", F.year("dispatch_date").alias("year"))
    df = award.withColumn("id", F.col("id").cast("string")).join(notices, "id")
    abroad = other_countries(F.col("winner_country"), F.col("country"))
    return quality.winner_quality(df, ["year", "country"], F.col("winner"), F.col("winner_country"), F.col("offers"), abroad)


def page_winners(api: DataFrame, start: dt.date = dt.date(2023, 10, 1)) -> DataFrame:
    known = api.filter((F.col("type") == "can") & F.col("country").isNotNull() & (F.col("dispatch_date") >= F.lit(start)))
    return known.groupBy(F.year("dispatch_date").alias("year"), "country").agg(
        F.count(F.lit(1)).alias("notices"), filled_share(F.col("winner_country")).alias("winner_country"),
        yes_share(F.col("winner_country") != F.col("country_iso3")).alias("cross_border"))


def value_outliers(notice_all: DataFrame) -> DataFrame:
    return quality.value_outliers(counted_notices(notice_all), ["type", F.year("dispatch_date").alias("year"), "country"], F.col("value_eur"))


def publication_lag(notice_all: DataFrame) -> DataFrame:
    api = notice_all.filter((F.col("source") == "api") & F.col("country").isNotNull())
    return quality.lag_report(api, ["type", F.year("pub_date").alias("year"), "country"], F.datediff("pub_date", "dispatch_date"))


def call_to_award(cn: DataFrame, can: DataFrame, notice_all: DataFrame) -> DataFrame:
    """Link share and median lag: by the export's link to the award, and by procedure on the pages."""
    linked = cn.select(F.col("future_can_id").cast("string").alias("id"), "country", F.col("dispatch_date").alias("call_day")).join(
        can.select(F.col("id").cast("string").alias("id"), F.col("dispatch_date").alias("award_day")), "id", "left")
    by = [F.year("call_day").alias("year"), "country"]
    export = quality.linked_lag(linked, by, F.col("call_day"), F.col("award_day")).withColumn("source", F.lit("csv"))
    api = notice_all.filter((F.col("source") == "api") & F.col("procedure_id").isNotNull())
    call = (F.col("type") == "cn") & F.col("country").isNotNull()
    pages = quality.call_to_award(api, "procedure_id", F.col("dispatch_date"), call, F.col("type") == "can",
                                  {"country": F.min(F.when(call, F.col("country")))})
    return export.unionByName(quality.linked_lag(pages, by, F.col("call_day"), F.col("award_day")).withColumn("source", F.lit("api")))


def code_audit(notice_all: DataFrame, field: str, k: int = 25) -> DataFrame:
    counted = notice_all.groupBy("source", F.col(f"{field}_raw").alias("raw"), F.col(field).alias("harmonised")).agg(F.count(F.lit(1)).alias("notices"))
    return counted.orderBy(F.col("notices").desc(), "source", "raw").limit(k)


# --- the pulse, who buys, who wins ---------------------------------------------------------------

def pulse(monthly: DataFrame, countries: Sequence[str], base_year: int = 2019) -> DataFrame:
    """Index of calls per month; the ALL series covers every country, not only the shown ones."""
    calls = monthly.filter(F.col("type") == "cn").select("country", "month", "procedures")
    series = shares.with_total_group(calls, "country", ["month"], ["procedures"]).filter(F.col("country").isin("ALL", *countries))
    return shares.index_series(series, "country", "month", "procedures", base_year)


def winner_sizes(award_api: DataFrame, year: int, least_total: int = 5000, least_known: int = 500) -> DataFrame:
    counts = award_api.filter(F.year("dispatch_date") == year).groupBy("country", F.coalesce("winner_size", F.lit("unknown")).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    return shares.share_among_known(counts, ["country"], "size", "n", "unknown", least_total, least_known)


def sme_share(award: DataFrame, notice_can: DataFrame, year: int) -> DataFrame:
    notices = notice_can.filter(F.year("dispatch_date") == year).select("id", "country")
    known = award.filter(F.col("sme").isin("Y", "N")).join(notices, "id")
    return known.groupBy("country").agg(yes_share(F.col("sme") == "Y").alias("sme_share"))


def buyer_types(notice_all: DataFrame, year: int) -> DataFrame:
    df = notice_all.filter((F.col("type") == "can") & (F.year("dispatch_date") == year) & F.col("country").isNotNull())
    named = ["regional-local", "public-law-body", "central", "utility", "eu-international"]
    return shares.composition(df, ["country"], F.col("buyer_type"), F.count_distinct(_procedure()), named)


def summary(notice_all: DataFrame, last: dt.date | None = None, keep: int = 9) -> DataFrame:
    """Calls by several dimensions and awards by value, long form.

    Only activities and product divisions are folded to their largest ``keep``; years, classes and values stay whole.
    """
    first = ["contract_type", "buyer_type", "activity", "cpv_div", "procedure"]
    p = to_procedures(counted_notices(notice_all, last), ["type", "proc"], "dispatch_date", "pub_number", first=first, distinct_sum={"v": F.col("v")})
    call, award = F.col("type") == "cn", F.col("type") == "can"
    panels = {"year": F.when(call, F.year("first_date"))}
    panels |= {name: F.when(call, F.coalesce(name, F.lit("unknown"))) for name in first}
    panels["value"] = F.when(award, magnitude(F.col("v")))
    return shares.top_and_other(shares.long_counts(p, panels), ["panel"], "category", "n", keep, where=F.col("panel").isin("activity", "cpv_div"))


# --- functions of government ----------------------------------------------------------------------

def _with_function(notice_all: DataFrame, code_map: DataFrame, last: dt.date | None = None) -> DataFrame:
    return resolve_function(counted_notices(notice_all, last), code_map, "cpv", codes.owner_function(F.col("activity")))


def function_panel(notice_all: DataFrame, code_map: DataFrame) -> DataFrame:
    """Procedures, values and contested procedures per month, country and government function."""
    p = to_procedures(_with_function(notice_all, code_map), ["type", "proc"], "dispatch_date", "pub_number", country="country",
                      first=["function", "function_source", "band"], distinct_sum={"value_eur": F.col("v")})
    contested = labels.BANDS[0][1]
    return p.groupBy("type", "country", month_start(F.col("first_date")).alias("month"), "function", "function_source").agg(
        F.count(F.lit(1)).alias("procedures"), F.count("value_eur").alias("procedures_with_value"), F.sum("value_eur").alias("value_eur"),
        F.count_if(F.col("band") == contested).alias("procedures_contested"))


def function_shares(panel: DataFrame) -> DataFrame:
    yearly = panel.groupBy("type", "country", F.year("month").alias("year"), "function").agg(
        F.sum("procedures").alias("procedures"), F.coalesce(F.sum("value_eur"), F.lit(0.0)).alias("value_eur"))
    return shares.with_shares(yearly, ["type", "country", "year"], {"procedures": "share_procedures", "value_eur": "share_value"})


def dense_function_shares(yearly: DataFrame, years: Sequence[int]) -> DataFrame:
    wanted = [*codes.FUNCTIONS, "unresolved"]
    known = yearly.filter((F.col("type") == "can") & F.col("function").isin(*wanted)).select("country", "year", "function", "share_value")
    return shares.densify(known, ["country"], {"year": list(years), "function": wanted}, {"share_value": 0.0})


def double_tagging(notice_all: DataFrame, code_map: DataFrame, tags: DataFrame, last: dt.date | None = None, green: str = "05") -> DataFrame:
    """Award procedures by primary and secondary function; ``tags`` holds cpv and the secondary label."""
    divisions = tags.select("cpv", F.left("secondary", F.lit(2)).alias("sec_div"))
    df = _with_function(notice_all, code_map, last).filter(F.col("type") == "can").join(divisions, "cpv", "left").withColumn("green", F.col("sec_div") == green)
    p = to_procedures(df, ["proc"], "dispatch_date", "pub_number", country="country", first=["function", "sec_div"], any_true=["green"],
                      distinct_sum={"value_eur": F.col("v")})
    return p.groupBy("country", F.year("first_date").alias("year"), "function", F.coalesce("sec_div", F.lit("none")).alias("sec_div"), "green").agg(
        F.count(F.lit(1)).alias("procedures"), F.sum("value_eur").alias("value_eur"))


def tagged_share(double: DataFrame, by: Sequence[str] = ("function",)) -> DataFrame:
    """Share of value with a second function, and with one in another division."""
    value, tagged = F.col("value_eur"), F.col("sec_div") != "none"
    return double.filter(F.col("function").isin(*codes.FUNCTIONS)).groupBy(*by).agg(
        share(F.sum(F.when(tagged, value)), F.sum(value)).alias("tagged"),
        share(F.sum(F.when(tagged & (F.col("sec_div") != F.col("function")), value)), F.sum(value)).alias("cross_tagged"))


def secondary_functions(double: DataFrame, keep: int = 5) -> DataFrame:
    """Shares of each function's value with a second function, the largest second functions by name."""
    known = double.filter(F.col("function").isin(*codes.FUNCTIONS))
    return shares.stacked_shares(known, "function", "sec_div", "value_eur", "none", keep, "Other secondary")


def green_layers(double: DataFrame, green: str = "05") -> DataFrame:
    n, main = F.col("procedures"), F.col("function") == green
    layers = double.groupBy("country", "year").agg(
        share(F.sum(F.when(main, n).otherwise(0)), F.sum(n)).alias("primary_purpose"),
        share(F.sum(F.when(F.col("green") & ~main, n).otherwise(0)), F.sum(n)).alias("co_purpose"))
    return shares.long(layers, ["country", "year"], ["primary_purpose", "co_purpose"], "layer", "share")


def keyword_calls(api: DataFrame, words: Sequence[str] = GREEN_WORDS) -> DataFrame:
    """Share of calls per month whose title or description mentions one of the words."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
    counted = api.filter(F.col("type") == "cn").groupBy("country", month_start(F.col("pub_date")).alias("month")).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(mentions(text, tuple(words))).alias("hits"))
    return counted.withColumn("share", share(F.col("hits"), F.col("calls")))


def digital_procedures(notice_all: DataFrame, stems: DataFrame, last: dt.date | None = None, lengths: Sequence[int] = tuple(range(2, 9))) -> DataFrame:
    """Award procedures by the category of the longest product stem."""
    awards = counted_notices(notice_all, last).filter(F.col("type") == "can")
    p = to_procedures(awards, ["proc"], "dispatch_date", "pub_number", country="country", first=["cpv"])
    classed = prefix_class(p, "cpv", stems, lengths, default="not ICT")
    counted = classed.groupBy("country", F.year("first_date").alias("year"), F.col("category").alias("kind")).agg(F.count(F.lit(1)).alias("procedures"))
    return shares.with_shares(counted, ["country", "year"], {"procedures": "share"})


def _official(expenditure: DataFrame) -> DataFrame:
    """Official expenditure by our country code, function and year."""
    own_code = codes.by_table(F.col("geo"), {office: iso2 for iso2, office in codes.STATISTICS_OFFICE_CODES.items()})
    kept = expenditure.filter(F.col("na_item").isin(*EXPENDITURE_ITEMS)).select(
        own_code.alias("country"), F.replace("cofog99", F.lit("GF"), F.lit("")).alias("function"),
        F.left(F.col("time").cast("string"), F.lit(4)).try_cast("int").alias("year"), F.col("values").alias("official"))
    return kept.filter(F.col("country").isNotNull() & F.col("function").isin(*codes.FUNCTIONS)).groupBy("country", "function", "year").agg(F.sum("official").alias("official"))


def _both(yearly: DataFrame, expenditure: DataFrame, countries: Sequence[str]) -> DataFrame:
    ours = yearly.filter((F.col("type") == "can") & F.col("function").isin(*codes.FUNCTIONS) & F.col("country").isin(*countries)).select(
        "country", "function", "year", F.col("value_eur").alias("ours"))
    return ours.join(_official(expenditure), ["country", "function", "year"], "full_outer").filter(F.col("country").isin(*countries))


def expenditure_benchmark(yearly: DataFrame, expenditure: DataFrame, countries: Sequence[str], year: int = 2022) -> DataFrame:
    return log_correlation(_both(yearly, expenditure, countries).filter(F.col("year") == year), "country", "ours", "official")


def expenditure_windows(yearly: DataFrame, expenditure: DataFrame, countries: Sequence[str],
                        windows: Sequence[tuple[int, int]] = ((2022, 2022), (2019, 2022), (2016, 2022))) -> DataFrame:
    return log_correlation_by_window(_both(yearly, expenditure, countries), "country", "year", ["function"], "ours", "official", windows)


# --- multinationals ---------------------------------------------------------------------------------

def won_by_name(award: DataFrame, notice_can: DataFrame) -> DataFrame:
    """Awards and split notice value per winner name, winner country and buyer country."""
    value = plausible_value(F.col("value_eur_fin1"), F.col("framework"))
    notices = notice_can.select("id", "country", "awards", value.alias("value"))
    df = award.filter(F.col("winner").isNotNull()).select("id", "winner", "winner_country").join(notices, "id")
    return df.groupBy("winner", "winner_country", "country").agg(F.count(F.lit(1)).alias("awards"), F.sum(matching.split_value(df, F.col("value"))).alias("value_eur"))


def multinational_shares(won: DataFrame, matches: DataFrame, headquarters: DataFrame, join_on: str = "winner_country",
                         countries: DataFrame | None = None) -> DataFrame:
    """Share of each buyer country's awards and value won by matched firms, by the parent's region.

    Matches carry the winner's country, so they join on it; ``join_on="country"`` joins on
    the buyer's country instead and then leaves cross-border wins out.  ``countries`` is the worldwide
    table given to ``match_winners``.
    """
    fixed = F.coalesce(F.nullif("hq_iso3", F.lit("")), codes.by_table(F.col("parent"), KNOWN_HEADQUARTERS))
    coded = with_country(matches, "iso3", join_on, countries, back=True)
    located = coded.join(headquarters.groupBy("parent").agg(F.min("hq_iso3").alias("hq_iso3")), "parent", "left").select("winner", join_on, fixed.alias("hq"))
    totals = won.groupBy("country").agg(F.sum("awards").alias("all_awards"), F.sum("value_eur").alias("all_value"))
    region = codes.headquarters_region(F.col("hq"), codes.by_table(F.col("country"), codes.COUNTRIES))
    by_region = won.join(located, ["winner", join_on]).groupBy("country", region.alias("region")).agg(F.sum("awards").alias("awards"), F.sum("value_eur").alias("value_eur"))
    return by_region.join(totals, "country").withColumns({"share": share(F.col("value_eur"), F.col("all_value")), "share_awards": share(F.col("awards"), F.col("all_awards"))})


def origin_matrix(won: DataFrame, matches: DataFrame, headquarters: DataFrame, join_on: str = "winner_country", countries: DataFrame | None = None,
                  rows: int = 20, columns: int = 10) -> DataFrame:
    """Value won by headquarters country and its share of the buyer country's whole value: largest buyers, largest headquarters."""
    coded = with_country(matches, "iso3", join_on, countries, back=True)
    located = coded.join(headquarters.groupBy("parent").agg(F.min("hq_iso3").alias("hq")), "parent").filter("hq is not null").select("winner", join_on, "hq")
    totals = won.groupBy("country").agg(F.sum("value_eur").alias("all_value"))
    by_origin = won.join(located, ["winner", join_on]).groupBy("country", "hq").agg(F.sum("value_eur").alias("value_eur"))
    cells = by_origin.join(totals, "country").withColumn("share", share(F.col("value_eur"), F.col("all_value")))
    return shares.heat_table(cells, "country", "hq", "value_eur", rows, columns)
