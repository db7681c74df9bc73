"""Result notices to one row per winner."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticework.functions.nested import aligned, distinct_known, in_first_language, items, language_texts, single_or_aligned


def explode_winners(notices: DataFrame, keep: Sequence[str], names: str = "winner_names", countries: str = "winner_countries",
                    ids: str = "winner_ids", sizes: str = "winner_sizes") -> DataFrame:
    """One row per distinct winner of a notice, with the country, number and size that belong to it.

    Names come one per tender, the other lists one per organisation.  A list is read by
    position only when it is as long as the list of names and no name was repeated; a single
    distinct country holds for every winner.
    """
    first_texts = notices.withColumn("__texts", in_first_language(language_texts(F.col(names))))
    lists = first_texts.select(*keep, items(F.col("__texts")).alias("__tenders"), items(F.col(countries)).alias("__countries"),
                               items(F.col(ids)).alias("__ids"), items(F.col(sizes)).alias("__sizes"))
    lists = lists.withColumn("__names", distinct_known(F.col("__tenders")))
    rows = lists.select("*", F.size("__names").alias("n_winners"), F.posexplode_outer("__names").alias("__pos", "winner")).filter(F.col("winner").isNotNull())
    position = F.col("__pos") + 1
    expected = F.when(F.size("__tenders") == F.col("n_winners"), F.col("n_winners"))
    return rows.select(
        *keep, "winner", "n_winners", single_or_aligned(F.col("__countries"), position, expected).alias("winner_country"),
        aligned(F.col("__ids"), position, expected).alias("winner_id"), aligned(F.col("__sizes"), position, expected).alias("winner_size"))
