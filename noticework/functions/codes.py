"""Code harmonisation: ordered keyword rules and fixed code tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words in the export's activity labels -> harmonised activity.  Order matters:
# the first rule that fits wins ("airport" has to come before "port").
ACTIVITY_WORDS = (
    ("health", "health"),
    ("education", "education"),
    ("general public", "gen-pub"),
    ("public order", "pub-os"),
    ("defence", "defence"),
    ("environment", "env-pro"),
    ("economic", "econ-aff"),
    ("housing", "hc-am"),
    ("social", "soc-pro"),
    ("recreation", "rcr"),
    ("electricity", "electricity"),
    ("gas", "gas-heat"),
    ("heat", "gas-heat"),
    ("water", "water"),
    ("urban", "urttb"),
    ("railway", "rail"),
    ("airport", "airport"),
    ("port", "port"),
    ("postal", "post"),
    ("exploration", "extraction"),
    ("extraction", "extraction"),
    ("other", "other"),
)

# Buyer type codes of the yearly export and of the JSON pages.
EXPORT_BUYER_TYPES = {
    "1": "central", "N": "central", "3": "regional-local", "R": "regional-local", "4": "utility",
    "5": "eu-international", "5A": "eu-international", "6": "public-law-body", "8": "other",
}
PAGE_BUYER_TYPES = {
    "cga": "central", "ra": "regional-local", "la": "regional-local", "spec-rights-entity": "utility",
    "eu-ins-bod-ag": "eu-international", "int-org": "eu-international",
}
PAGE_BUYER_PREFIXES = {"body-pl": "public-law-body", "pub-undert": "utility"}

# Procedure codes of the yearly export; the pages already use the harmonised names.
EXPORT_PROCEDURES = {
    "OPE": "open", "RES": "restricted", "COD": "comp-dial", "NEC": "neg-w-call", "NEG": "neg-w-call",
    "NIC": "neg-w-call", "NOC": "neg-wo-call", "NOP": "neg-wo-call", "AWP": "neg-wo-call", "INP": "innovation",
}
PROCEDURES = ("open", "restricted", "comp-dial", "neg-w-call", "neg-wo-call", "innovation")

# Contract nature on the pages -> one-letter contract type of the export.
CONTRACT_NATURES = {"works": "W", "supplies": "U", "services": "S"}
FORM_TYPES = {"competition": "cn", "result": "can"}

# Buyer activity -> government function division.
ACTIVITY_FUNCTION = {
    "gen-pub": "01", "defence": "02", "pub-os": "03", "econ-aff": "04", "env-pro": "05", "hc-am": "06",
    "health": "07", "rcr": "08", "education": "09", "soc-pro": "10", "water": "06", "electricity": "04",
    "gas-heat": "04", "gas-oil": "04", "solid-fuel": "04", "extraction": "04", "rail": "04", "urttb": "04",
    "airport": "04", "port": "04", "post": "04",
}
FUNCTIONS = tuple(f"{n:02d}" for n in range(1, 11))

# Country codes used by the sources (two letters, three letters).
COUNTRIES = {
    "AT": "AUT", "BE": "BEL", "BG": "BGR", "CH": "CHE", "CY": "CYP", "CZ": "CZE", "DE": "DEU", "DK": "DNK",
    "EE": "EST", "ES": "ESP", "FI": "FIN", "FR": "FRA", "GR": "GRC", "HR": "HRV", "HU": "HUN", "IE": "IRL",
    "IS": "ISL", "IT": "ITA", "LI": "LIE", "LT": "LTU", "LU": "LUX", "LV": "LVA", "MK": "MKD", "MT": "MLT",
    "NL": "NLD", "NO": "NOR", "PL": "POL", "PT": "PRT", "RO": "ROU", "SE": "SWE", "SI": "SVN", "SK": "SVK",
    "UK": "GBR",
}
ISO3_TO_ISO2 = {iso3: iso2 for iso2, iso3 in COUNTRIES.items()}
STATISTICS_OFFICE_CODES = {**{c: c for c in COUNTRIES}, "GR": "EL"}
ASIAN_HEADQUARTERS = ("JPN", "KOR", "CHN", "TWN", "HKG", "IND", "SGP")


def by_words(text: Column, rules: Iterable[tuple[str, str]], default: str | None = None) -> Column:
    """Label of the first rule whose word occurs in the text, whatever its case."""
    lowered = F.lower(text)
    ladder: Column | None = None
    for word, label in rules:
        hit = F.contains(lowered, F.lit(word.lower()))
        ladder = F.when(hit, label) if ladder is None else ladder.when(hit, label)
    return ladder if default is None else ladder.otherwise(default)


def by_table(code: Column, table: Mapping[str, str], default: Column | str | None = None) -> Column:
    """Exact code lookup in a fixed table; NULL stays NULL, unknown codes take the default.

    Codes that share a label share one ``IN`` branch, so the expression stays as short as the
    number of labels.
    """
    labels: dict[str, list[str]] = {}
    for key, label in table.items():
        labels.setdefault(label, []).append(key)
    ladder: Column | None = None
    for label, keys in labels.items():
        hit = code.isin(*keys)
        ladder = F.when(hit, label) if ladder is None else ladder.when(hit, label)
    if default is None:
        return ladder
    fallback = default if isinstance(default, Column) else F.lit(default)
    return ladder.when(code.isNotNull(), fallback)


def activity_from_export(text: Column) -> Column:
    return by_words(text, ACTIVITY_WORDS)


def buyer_type_from_export(code: Column) -> Column:
    return by_table(code, EXPORT_BUYER_TYPES)


def buyer_type_from_page(code: Column) -> Column:
    prefixed: Column = F.lit("other")
    for prefix, label in PAGE_BUYER_PREFIXES.items():
        prefixed = F.when(F.startswith(code, F.lit(prefix)), label).otherwise(prefixed)
    return by_table(code, PAGE_BUYER_TYPES, default=prefixed)


def procedure_from_export(code: Column) -> Column:
    return by_table(code, EXPORT_PROCEDURES, default="other")


def procedure_from_page(code: Column) -> Column:
    return by_table(code, {p: p for p in PROCEDURES}, default="other")


def owner_function(activity: Column) -> Column:
    """Function of the buyer's activity; 'unresolved' where the activity says nothing."""
    return F.coalesce(by_table(activity, ACTIVITY_FUNCTION), F.lit("unresolved"))


def headquarters_region(hq: Column, home: Column, european: Iterable[str] = tuple(COUNTRIES.values()),
                        american: str = "USA", asian: Iterable[str] = ASIAN_HEADQUARTERS) -> Column:
    """Where the parent sits, seen from the buyer's country."""
    return (
        F.when(hq.isNull(), "Unknown HQ")
        .when(hq == home, "Domestic parent")
        .when(hq.isin(*european), "European parent")
        .when(hq == american, "US parent")
        .when(hq.isin(*asian), "Asian parent")
        .otherwise("Other parent")
    )
