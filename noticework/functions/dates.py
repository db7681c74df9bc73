"""Date columns: exports with several notations, ISO stamps with offsets, months, lags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-digit years above this belong to the previous century.
LAST_TWO_DIGIT_YEAR = 2068


def _same_century(day: Column) -> Column:
    return F.when(F.year(day) > LAST_TWO_DIGIT_YEAR, F.add_months(day, -1200)).otherwise(day).cast("date")


def mixed_day(text: Column) -> Column:
    """Day from ``31/12/23`` or ``05-JAN-16`` (month in any case); anything else is NULL."""
    pieces = F.split(text, "-")
    named_month = F.concat_ws("-", pieces[0], F.initcap(F.try_element_at(pieces, F.lit(2))), F.try_element_at(pieces, F.lit(3)))
    slashed = F.try_to_timestamp(text, F.lit("d/M/yy")).cast("date")
    dashed = F.try_to_timestamp(named_month, F.lit("d-MMM-yy")).cast("date")
    return _same_century(F.coalesce(slashed, dashed))


def iso_day(text: Column) -> Column:
    """Day from ISO text that may carry an offset or a time (``2024-05-02+02:00``)."""
    return F.left(text, F.lit(10)).try_cast("date")


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM")


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start)
