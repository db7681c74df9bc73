"""Money and number columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Plausible bounds of one notice in euro, and the cap on one award.
PLAUSIBLE_LOW = 1e3
PLAUSIBLE_HIGH = 999_999_999.0
AWARD_CAP = 1e8


def number(text: Column) -> Column:
    return text.try_cast("double")


def whole_number(text: Column) -> Column:
    """Integer from text; decimals round half away from zero, junk is NULL."""
    return F.round(text.try_cast("double")).try_cast("int")


def plausible_value(value: Column, framework: Column | None = None,
                    low: float = PLAUSIBLE_LOW, high: float = PLAUSIBLE_HIGH) -> Column:
    """The value when inside the bounds and not a framework ceiling, else NULL."""
    keep = value.between(low, high)
    if framework is not None:
        keep = keep & ~F.coalesce(framework, F.lit(False))
    return F.when(keep, value)


def share(part: Column, whole: Column) -> Column:
    """``part / whole``, NULL where the whole is zero or unknown."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def yes_share(condition: Column) -> Column:
    """Share of rows where the condition holds; rows where it is NULL do not count."""
    return F.avg(condition.cast("int"))


def filled_share(value: Column) -> Column:
    return F.avg(value.isNotNull().cast("int"))


def true_share(flag: Column) -> Column:
    """Share of all rows where a nullable flag is true."""
    return F.avg(F.coalesce(flag, F.lit(False)).cast("int"))


def weighted_mean(value: Column, weight: Column) -> Column:
    known = value.isNotNull() & weight.isNotNull()
    return F.try_divide(F.sum(F.when(known, value * weight)), F.sum(F.when(known, weight).cast("double")))


def magnitude(value: Column) -> Column:
    """Power of ten below the value: 3 for 1 000 up to 9 999."""
    return F.floor(F.log10(value)).cast("int")


def first_known_pair(*pairs: tuple[Column, Column | None]) -> Column:
    """First ``(value, currency)`` pair whose value is known, kept together as a struct.

    Value and currency never come from two different fields: a ceiling without a
    currency stays without one instead of borrowing a neighbour's.
    """
    options = []
    for value, currency in pairs:
        unit = F.lit(None).cast("string") if currency is None else currency
        options.append(F.when(value.isNotNull(), F.struct(value.alias("value"), unit.alias("currency"))))
    return F.coalesce(*options)
