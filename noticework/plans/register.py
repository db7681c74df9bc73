"""Winners against the company registers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticework.functions.codes import COUNTRIES, by_table
from noticework.functions.text import embedded_national_id, national_id, register_prefix
from noticework.operators import matching
from noticework.operators.labels import binned
from noticework.session import settled

# Size classes by number of employees.
SIZE_CLASSES = ((9.0, "micro"), (49.0, "small"), (249.0, "medium"), (float("inf"), "large"))


def with_country(df: DataFrame, code: str, name: str, countries: DataFrame | None = None, back: bool = False) -> DataFrame:
    """Three-letter code of a two-letter one (``back``: the reverse), NULL where unknown.

    ``countries`` holds ``iso2`` and ``iso3`` of any part of the world; the built-in table of the
    notices' own countries comes first, so that their special codes stay.
    """
    own = {iso3: iso2 for iso2, iso3 in COUNTRIES.items()} if back else COUNTRIES
    if countries is None:
        return df.withColumn(name, by_table(F.col(code), own))
    known, wanted = ("iso3", "iso2") if back else ("iso2", "iso3")
    world = countries.filter(F.col(known).isNotNull()).groupBy(F.col(known).alias("__code")).agg(F.min(wanted).alias("__found"))
    joined = df.join(world, F.col(code) == F.col("__code"), "left")
    return joined.withColumn(name, F.coalesce(by_table(F.col(code), own), F.col("__found"))).drop("__code", "__found")


def match_winners(award: DataFrame, register: DataFrame, countries: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Winner names, register names and their matches; ``countries`` (iso2, iso3) covers winners from elsewhere."""
    located = with_country(award, "winner_country", "iso3", countries)
    winners = settled(matching.winner_names(located, "award_value_eur_fin1"), "winners")
    entries = settled(matching.register_names(register), "register")
    return winners, entries, settled(matching.match_all(winners, entries), "matches")


def leading_parents(matches: DataFrame, headquarters: DataFrame, k: int = 25, by: str = "awards") -> DataFrame:
    """The k parents whose subsidiaries win the most awards (``by="value_capped"``: the most value)."""
    return matching.parents(matches, headquarters).orderBy(F.col(by).desc(), "parent").limit(k)


def match_companies(winner_ids: DataFrame, companies: DataFrame) -> DataFrame:
    """Winner register numbers joined to a company file by country prefix and national number."""
    prefix = register_prefix(F.col("country"))
    ours = winner_ids.select(prefix.alias("prefix"), national_id(prefix, F.col("winner_id_norm")).alias("natid"), "awards")
    theirs = companies.select(F.left("bvdid", F.lit(2)).alias("prefix"), embedded_national_id(F.col("bvdid")).alias("natid"), "sector",
                              F.left("guo_bvdid", F.lit(2)).alias("owner_country"), binned(F.col("employees").try_cast("double"), SIZE_CLASSES).alias("size"))
    return ours.join(theirs, ["prefix", "natid"])


def match_coverage(winner_ids: DataFrame, matched: DataFrame) -> DataFrame:
    """Winner register numbers and their awards per prefix, and how many of both found a company."""
    known = winner_ids.groupBy(register_prefix(F.col("country")).alias("prefix")).agg(F.count(F.lit(1)).alias("ids"), F.sum("awards").alias("awards"))
    found = matched.groupBy("prefix").agg(F.count(F.lit(1)).alias("matched"), F.sum("awards").alias("awards_matched"))
    return known.join(found, "prefix", "left")


def company_profile(matched: DataFrame, by: str) -> DataFrame:
    """Aggregates only: winners and awards by sector, owner country or size."""
    return matched.groupBy("prefix", by).agg(F.count(F.lit(1)).alias("winners"), F.sum("awards").alias("awards"))
