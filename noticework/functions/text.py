"""Text columns: name normalisation, register numbers, notice numbers, keyword hits."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms dropped from company names (already upper-cased, accents and dots removed).
LEGAL_FORMS = """
SA SAS SASU SARL EURL SNC SCA SCS SE GMBH AG KG CO MBH OHG SRL SRLS SPA SL SLU SAU BV NV VOF AB OY OYJ AS ASA APS
LTD LIMITED PLC LLC INC CORP CORPORATION COMPANY SRO KFT ZRT NYRT DOO AD EOOD OOD EAD UAB SIA OU AKTIENGESELLSCHAFT
""".split()
LEGAL_PHRASES = (
    "A S", "SP Z OO", "SP Z O O", "S R O", "D O O", "GESELLSCHAFT MIT BESCHRANKTER HAFTUNG", "SOCIETE ANONYME",
    "SOCIEDAD ANONIMA", "SOCIEDAD LIMITADA", "SOCIETA PER AZIONI",
)

# Shortest normalised name that may identify a company.
NAME_FLOOR = 5
# Shortest register number that may identify a company.
REGISTER_FLOOR = 6


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Character table from Unicode decompositions: base letters first, pure marks (dropped) last."""
    mapped: list[tuple[str, str]] = []
    dropped: list[str] = []
    for point in [*range(0x00C0, 0x0530), *range(0x1E00, 0x2000)]:
        char = chr(point)
        base = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")
        if base == char:
            continue
        if len(base) == 1:
            mapped.append((char, base))
        elif not base:
            dropped.append(char)
    return "".join(m[0] for m in mapped) + "".join(dropped), "".join(m[1] for m in mapped)

# Length for substrings that take the rest of a text.
TO_END = 1 << 30


def without_accents(text: Column) -> Column:
    source, target = _accent_table()
    return F.translate(text, source, target)


def company_name(text: Column) -> Column:
    """Upper-case ASCII words without legal forms, single-spaced."""
    forms = "|".join([*LEGAL_PHRASES, *LEGAL_FORMS])
    plain = F.translate(without_accents(F.replace(text, F.lit("."), F.lit(""))), "ıſ", "IS")
    words = F.upper(F.regexp_replace(plain, "[^A-Za-z0-9]+", " "))
    bare = F.regexp_replace(words, rf"\b({forms})\b", " ")
    return F.trim(F.regexp_replace(bare, " +", " "))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def register_number(text: Column, iso3: Column) -> Column:
    """Digits of a register number; French ones shortened to the nine that name the firm."""
    number = digits(text)
    return F.when(iso3 == "FRA", F.left(number, F.lit(9))).otherwise(number)


def usable_register_number(text: Column, iso3: Column) -> Column:
    number = register_number(text, iso3)
    return F.when(F.length(number) >= REGISTER_FLOOR, number)


def register_prefix(country: Column) -> Column:
    """Country prefix of a company identifier (the United Kingdom files under GB)."""
    return F.when(country == "UK", "GB").otherwise(country)


def national_id(prefix: Column, raw: Column) -> Column:
    """One national number from the spellings found on notices.

    French establishment and VAT numbers come down to the nine-digit firm number; a
    leading country prefix in front of digits is dropped.
    """
    short = (
        F.when((prefix == "FR") & raw.rlike("^[0-9]{14}$"), F.substring(raw, 1, 9))
        .when((prefix == "FR") & raw.rlike("^FR[0-9]{11}$"), F.substring(raw, 5, 9))
        .otherwise(raw)
    )
    carries_prefix = F.startswith(short, prefix) & F.substring(short, 3, 1).rlike("^[0-9]$")
    return F.when(carries_prefix, F.substring(short, 3, TO_END)).otherwise(short)


def embedded_national_id(company_id: Column) -> Column:
    """Letters and digits after the two-letter prefix of a company identifier."""
    return F.upper(F.regexp_replace(F.substring(company_id, 3, TO_END), "[^A-Za-z0-9]", ""))


def first_word(name: Column) -> Column:
    return F.substring_index(name, " ", 1)


def notice_number(export_id: Column) -> Column:
    """``2023263753`` (year, running number) to the printed form ``263753-2023``; other ids stay as they are."""
    running = F.substring(export_id, 5, TO_END).try_cast("bigint").cast("string")
    printed = F.when(export_id.rlike("^[0-9]{5,}$"), F.concat(running, F.lit("-"), F.substring(export_id, 1, 4)))
    return F.coalesce(printed, export_id)


def mentions(text: Column, words: list[str] | tuple[str, ...]) -> Column:
    """Whether the lower-cased text holds one of the words (regular expressions allowed)."""
    return F.lower(text).rlike("|".join(words))


def other_countries(joined: Column, home: Column, separator: str = "---") -> Column:
    """Whether a ``AT---DE`` style country list names any country but ``home``."""
    rest = F.replace(F.replace(joined, home, F.lit("")), F.lit(separator), F.lit(""))
    return rest != ""


def clipped(text: Column, limit: int | None) -> Column:
    """The text, cut to ``limit`` characters only where a limit is asked for."""
    return text if limit is None else F.left(text, F.lit(limit))
