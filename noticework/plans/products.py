"""Product tables: notices, awards, the stitched history, winners of recent notices."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticework.functions import codes
from noticework.functions.dates import mixed_day
from noticework.functions.text import notice_number
from noticework.functions.values import first_known_pair, number, whole_number
from noticework.operators.entities import collapse_rows, keep_children_of, rollup_children
from noticework.operators.lookups import to_base_currency
from noticework.operators.ordering import best_rows
from noticework.operators.winners import explode_winners

# Dispatch dates for which the yearly export is complete.
Period = tuple[dt.date, dt.date]
EXPORT_PERIOD: Period = (dt.date(2016, 1, 1), dt.date(2023, 9, 30))

# Columns of the yearly export that every notice has, and their names here.
NOTICE_COLUMNS = {
    "ISO_COUNTRY_CODE": "country", "DT_DISPATCH": "dispatch_text", "TYPE_OF_CONTRACT": "contract_type", "CAE_TYPE": "buyer_type",
    "MAIN_ACTIVITY": "main_activity", "TOP_TYPE": "procedure_type", "B_FRA_AGREEMENT": "framework_code", "B_EU_FUNDS": "eu_funds_code",
    "CPV": "cpv", "TAL_LOCATION_NUTS": "nuts", "CANCELLED": "cancelled_code",
}
AWARD_COLUMNS = {
    "ID_LOT_AWARDED": "lot", "WIN_NAME": "winner", "WIN_COUNTRY_CODE": "winner_country", "WIN_NATIONALID": "winner_id",
    "B_CONTRACTOR_SME": "sme", "DT_AWARD": "award_text", "TITLE": "title",
}
AWARD_AMOUNTS = {"AWARD_VALUE_EURO": "award_value_eur", "AWARD_VALUE_EURO_FIN_1": "award_value_eur_fin1", "AWARD_EST_VALUE_EURO": "award_est_value_eur"}
AWARD_COUNTS = {"NUMBER_OFFERS": "offers", "NUMBER_TENDERS_OTHER_EU": "offers_other_eu", "NUMBER_TENDERS_NON_EU": "offers_non_eu"}


def _renamed(columns: Mapping[str, str]) -> list[Column]:
    return [F.col(source).alias(name) for source, name in columns.items()]


def _typed_notice(df: DataFrame, period: Period) -> DataFrame:
    """Types and derived columns of a collapsed export notice, inside the reliable period."""
    typed = df.withColumns({
        "dispatch_date": mixed_day(F.col("dispatch_text")),
        "main_activity": F.replace("main_activity", F.lit("\\"), F.lit(" ")),
        "framework": F.col("framework_code") == "Y", "eu_funds": F.col("eu_funds_code") == "Y", "cancelled": F.col("cancelled_code") == "1",
        "cpv_div": F.left("cpv", F.lit(2)), "nuts2": F.when(F.length("nuts") >= 4, F.left("nuts", F.lit(4)))})
    kept = typed.filter(F.col("dispatch_date").between(*[F.lit(day) for day in period]))
    return kept.drop("dispatch_text", "framework_code", "eu_funds_code", "cancelled_code")


def _collapsed(raw: DataFrame, identity: str, extra: Mapping[str, Column], period: Period, attributes: tuple[str, ...] = ()) -> DataFrame:
    values = {"value_eur": number(F.col("VALUE_EURO")), "value_eur_fin1": number(F.col("VALUE_EURO_FIN_1"))}
    rows = raw.filter(F.col("YEAR") >= str(period[0].year)).select(
        F.col(identity).alias("id"), *_renamed(NOTICE_COLUMNS), *[e.alias(n) for n, e in {**values, **extra}.items()])
    return collapse_rows(rows, ["id"], [*NOTICE_COLUMNS.values(), *values, *extra, *attributes])


def call_notices(raw_calls: DataFrame, period: Period = EXPORT_PERIOD) -> DataFrame:
    """``notice_cn``: one row per call for tenders dispatched in ``period``."""
    extra = {"future_can_id": F.col("FUTURE_CAN_ID"), "lots": whole_number(F.col("LOTS_NUMBER"))}
    return _typed_notice(_collapsed(raw_calls, "ID_NOTICE_CN", extra, period), period)


def award_rows(raw_awards: DataFrame, period: Period = EXPORT_PERIOD) -> DataFrame:
    """One row per (notice, award) out of the lot rows, before the notice filter."""
    rows = raw_awards.filter(F.col("YEAR") >= str(period[0].year)).select(
        F.col("ID_NOTICE_CAN").alias("id"), F.col("ID_AWARD").alias("award_id"), *_renamed(AWARD_COLUMNS),
        *[number(F.col(s)).alias(n) for s, n in AWARD_AMOUNTS.items()], *[whole_number(F.col(s)).alias(n) for s, n in AWARD_COUNTS.items()])
    attributes = [*AWARD_COLUMNS.values(), *AWARD_AMOUNTS.values(), *AWARD_COUNTS.values()]
    return collapse_rows(rows, ["id", "award_id"], attributes).withColumn("award_date", mixed_day(F.col("award_text"))).drop("award_text")


def award_notices(raw_awards: DataFrame, awards: DataFrame, period: Period = EXPORT_PERIOD) -> DataFrame:
    """``notice_can``: one row per award notice, with the number and sums of its awards."""
    notices = _typed_notice(_collapsed(raw_awards, "ID_NOTICE_CAN", {}, period), period)
    return rollup_children(notices, awards, "id", {
        "awards": F.count(F.lit(1)), "award_value_sum": F.sum("award_value_eur"), "award_value_fin1_sum": F.sum("award_value_eur_fin1"),
        "award_est_value_sum": F.sum("award_est_value_eur")})


def awards_of(awards: DataFrame, notices: DataFrame) -> DataFrame:
    """``award``: awards whose notice lies in the reliable period."""
    return keep_children_of(awards, notices, "id")


HISTORY_COLUMNS = ["source", "type", "pub_number", "procedure_id", "dispatch_date", "pub_date", "country", "contract_type", "buyer_type", "buyer_type_raw",
                   "activity", "activity_raw", "procedure", "procedure_raw", "framework", "eu_funds", "cpv", "cpv_div", "nuts", "nuts2", "cancelled",
                   "value", "value_cur", "future_can_id", "awards"]


def _from_export(df: DataFrame, kind: str) -> DataFrame:
    nothing = F.lit(None)
    own = set(df.columns)
    return df.withColumns({
        "source": F.lit("csv"), "type": F.lit(kind), "pub_number": notice_number(F.col("id")), "procedure_id": nothing.cast("string"),
        "pub_date": nothing.cast("date"), "buyer_type_raw": F.col("buyer_type"), "activity_raw": F.col("main_activity"),
        "procedure_raw": F.col("procedure_type"), "value": F.col("value_eur_fin1"), "value_cur": F.lit("EUR"),
        "buyer_type": codes.buyer_type_from_export(F.col("buyer_type")), "activity": codes.activity_from_export(F.col("main_activity")),
        "procedure": codes.procedure_from_export(F.col("procedure_type")),
        "future_can_id": F.col("future_can_id") if "future_can_id" in own else nothing.cast("string"),
        "awards": F.col("awards") if "awards" in own else nothing.cast("bigint")}).select(*HISTORY_COLUMNS)


def _from_pages(api: DataFrame) -> DataFrame:
    nothing = F.lit(None)
    total, estimate = (F.col("total_value"), F.col("total_value_cur")), (F.col("est_value"), F.col("est_value_cur"))
    lots, ceiling = (F.col("est_value_lots"), F.col("est_value_lot_cur")), (F.col("framework_max_value_lots"), None)
    pair = F.when(F.col("type") == "can", first_known_pair(total, estimate, lots)).otherwise(first_known_pair(estimate, lots, ceiling))
    activity = F.coalesce("main_activity", "entity_main_activity")
    return api.filter(F.col("type").isNotNull()).withColumn("__pair", pair).withColumns({
        "source": F.lit("api"), "buyer_type_raw": F.col("buyer_legal_type"), "buyer_type": codes.buyer_type_from_page(F.col("buyer_legal_type")),
        "activity": activity, "activity_raw": activity, "procedure_raw": F.col("procedure_type"),
        "procedure": codes.procedure_from_page(F.col("procedure_type")), "cancelled": nothing.cast("boolean"), "value": F.col("__pair.value"),
        "value_cur": F.col("__pair.currency"), "future_can_id": nothing.cast("string"), "awards": nothing.cast("bigint")}).select(*HISTORY_COLUMNS)


def history(cn: DataFrame, can: DataFrame, api: DataFrame, rates: DataFrame) -> DataFrame:
    """``notice_all``: one continuous history in euro; at the seam the page row wins.

    Rows without a number cannot be told apart, so all of them stay.
    """
    every = _from_export(cn, "cn").unionByName(_from_export(can, "can")).unionByName(_from_pages(api))
    numbered, unnumbered = every.filter(F.col("pub_number").isNotNull()), every.filter(F.col("pub_number").isNull())
    once = best_rows(numbered, ["type", "pub_number"], [F.col("source"), F.col("dispatch_date"), F.col("value")]).unionByName(unnumbered)
    return to_base_currency(once, rates, "value", "value_cur", F.coalesce("dispatch_date", "pub_date"), name="value_eur")


def page_awards(api: DataFrame, notice_all: DataFrame) -> DataFrame:
    """``award_api``: one row per winner of a result notice, with the notice value and its equal split."""
    keep = ["pub_number", "procedure_id", "dispatch_date", "country", "country_iso3"]
    winners = explode_winners(api.filter((F.col("type") == "can") & F.col("country").isNotNull()), keep)
    values = notice_all.filter((F.col("source") == "api") & (F.col("type") == "can")).select("pub_number", F.col("value_eur").alias("value_eur_notice"))
    return winners.join(values, "pub_number", "left").withColumn("value_eur_winner", F.col("value_eur_notice") / F.col("n_winners"))
