"""Response pages (one JSON document per line, a list of notices each) as typed notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructField, StructType

from noticework.functions.codes import CONTRACT_NATURES, FORM_TYPES, ISO3_TO_ISO2, by_table
from noticework.functions.dates import iso_day
from noticework.functions.nested import (any_equal, any_other_than, first_item, first_language, first_or_scalar,
                                         in_first_language, items, language_texts, total)
from noticework.functions.text import clipped
from noticework.functions.values import number

# Fields of a notice on a page.
PAGE_FIELDS = """
publication-number publication-date dispatch-date notice-type form-type procedure-identifier buyer-country buyer-name
organisation-identifier-buyer main-activity entity-main-activity buyer-legal-type classification-cpv place-of-performance
contract-nature procedure-type title-proc description-proc title-lot description-lot estimated-value-proc
estimated-value-cur-proc estimated-value-lot estimated-value-cur-lot framework-agreement-lot framework-maximum-value-lot
eu-fund-lot duration-period-value-lot duration-period-unit-lot total-value total-value-cur tender-value winner-name
organisation-identifier-tenderer winner-country winner-size winner-decision-date
""".split()

# Fields by shape: a list or a scalar of which the first value counts, a list read as a whole,
# an object keyed by language.
FIRST_FIELDS = """
procedure-identifier buyer-country organisation-identifier-buyer main-activity entity-main-activity buyer-legal-type
classification-cpv place-of-performance contract-nature estimated-value-proc estimated-value-cur-proc
estimated-value-cur-lot total-value total-value-cur duration-period-unit-lot winner-country winner-decision-date
""".split()
LANGUAGE_FIELDS = "buyer-name title-proc description-proc".split()

# Lists of which all values count.
LIST_FIELDS = "framework-agreement-lot eu-fund-lot estimated-value-lot framework-maximum-value-lot".split()

# Fields that pages usually hold as lists.
USUAL_LISTS = """
procedure-identifier buyer-country organisation-identifier-buyer main-activity entity-main-activity buyer-legal-type
classification-cpv place-of-performance contract-nature estimated-value-cur-lot
""".split() + LIST_FIELDS


def _page_type(shapes: dict[str, DataType]) -> StructType:
    return StructType([StructField("notices", ArrayType(StructType([StructField(f, shapes.get(f, StringType())) for f in PAGE_FIELDS])))])


# A field declared as text keeps nested JSON as raw text, whatever its shape.
PAGE_SCHEMA = _page_type({})

# The usual shapes, and the whole text of a page that differs from them anywhere.
USUAL_SCHEMA = _page_type(dict.fromkeys(USUAL_LISTS, ArrayType(StringType())) | dict.fromkeys(LANGUAGE_FIELDS, MapType(StringType(), StringType()))).add("other", StringType())
USUAL_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "other", "allowNonNumericNumbers": "false"}


def shaped_notices(lines: DataFrame, strict: bool = True) -> DataFrame:
    """One row per notice: ``usual`` with lists and language maps, or ``raw`` with every field as text.

    A page of the usual shapes is read by one parse.  Any other page is read again as text, and
    its fields by their own brackets later.  A malformed page stops the job, or with
    ``strict=False`` gives no notice.  The parsed values are used several times, so each stands
    in a step of its own; the outer explode keeps Spark from adding a test of the list below it,
    which would parse every page twice.
    """
    texts = F.from_json("doc.other", PAGE_SCHEMA, {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    usual = F.when(F.col("doc.other").isNull(), F.col("doc.notices"))
    empty = [F.array().cast(kind["notices"].dataType) for kind in (USUAL_SCHEMA, PAGE_SCHEMA)]
    return (lines.select("month", F.from_json("page", USUAL_SCHEMA, USUAL_OPTIONS).alias("doc"))
            .select("month", F.coalesce(usual, empty[0]).alias("usual"), F.coalesce(texts.getField("notices"), empty[1]).alias("raw"))
            .select("month", F.explode_outer(F.arrays_zip("usual", "raw")).alias("n"))
            .select("month", "n.usual", "n.raw").filter(F.col("usual").isNotNull() | F.col("raw").isNotNull()))


def parsed_notices(lines: DataFrame, strict: bool = True) -> DataFrame:
    """One row per notice with raw fields, lists (``list:``), language maps (``texts:``) and first values (``first:``)."""
    notices, structured = shaped_notices(lines, strict), USUAL_LISTS + LANGUAGE_FIELDS
    raw = {f: F.col(f"raw.`{f}`") for f in PAGE_FIELDS}
    usual = {f: F.col(f"usual.`{f}`") for f in PAGE_FIELDS}
    notices = notices.select(
        "month", *[raw[f].alias(f) if f in structured else F.coalesce(usual[f], raw[f]).alias(f) for f in PAGE_FIELDS],
        *[F.coalesce(usual[f], language_texts(raw[f])).alias(f"texts:{f}") for f in LANGUAGE_FIELDS],
        *[F.coalesce(usual[f], items(raw[f])).alias(f"list:{f}") for f in USUAL_LISTS])
    firsts = {f: first_item(F.col(f"list:{f}"), F.col(f)) if f in USUAL_LISTS else first_or_scalar(F.col(f)) for f in FIRST_FIELDS}
    firsts |= {f: first_or_scalar(in_first_language(F.col(f"texts:{f}"))) for f in LANGUAGE_FIELDS}
    return notices.withColumns({f"first:{f}": value for f, value in firsts.items()})


def flatten_pages(lines: DataFrame, text_limit: int | None = None, list_limit: int | None = None) -> DataFrame:
    """One typed row per notice.

    Texts are kept whole; ``text_limit`` and ``list_limit`` cut them on request.  List
    fields stay JSON text, as their consumers parse them once more by meaning.
    """

    def first(name: str) -> Column:
        return F.col(f"first:{name}")

    def raw(name: str) -> Column:
        return clipped(F.col(name), list_limit)

    form, country, nuts = F.col("form-type"), first("buyer-country"), first("place-of-performance")
    columns = {
        "pub_number": F.col("publication-number"),
        "procedure_id": first("procedure-identifier"),
        "pub_date": iso_day(F.col("publication-date")),
        "dispatch_date": iso_day(F.col("dispatch-date")),
        "month": F.col("month"),
        "notice_type": F.col("notice-type"),
        "form_type": form,
        "type": by_table(form, FORM_TYPES),
        "country_iso3": country,
        "country": by_table(country, ISO3_TO_ISO2),
        "buyer_name": first("buyer-name"),
        "buyer_id": first("organisation-identifier-buyer"),
        "main_activity": first("main-activity"),
        "entity_main_activity": first("entity-main-activity"),
        "buyer_legal_type": first("buyer-legal-type"),
        "contract_type": by_table(first("contract-nature"), CONTRACT_NATURES),
        "procedure_type": F.col("procedure-type"),
        "cpv": first("classification-cpv"),
        "cpv_div": F.left(first("classification-cpv"), F.lit(2)),
        "nuts": nuts,
        "nuts2": F.when(F.length(nuts) >= 4, F.left(nuts, F.lit(4))),
        "framework": any_other_than(F.col("list:framework-agreement-lot"), "none"),
        "eu_funds": any_equal(F.col("list:eu-fund-lot"), "eu-funds"),
        "lang": first_language(F.col("texts:title-proc")),
        "title": first("title-proc"),
        "description": clipped(first("description-proc"), text_limit),
        "lot_titles": raw("title-lot"),
        "lot_descriptions": raw("description-lot"),
        "est_value": number(first("estimated-value-proc")),
        "est_value_cur": first("estimated-value-cur-proc"),
        "est_value_lots": total(F.col("list:estimated-value-lot")),
        "est_value_lot_cur": first("estimated-value-cur-lot"),
        "framework_max_value_lots": total(F.col("list:framework-maximum-value-lot")),
        "total_value": number(first("total-value")),
        "total_value_cur": first("total-value-cur"),
        "tender_values": raw("tender-value"),
        "lot_durations": raw("duration-period-value-lot"),
        "lot_duration_unit": first("duration-period-unit-lot"),
        "winner_names": raw("winner-name"),
        "winner_ids": raw("organisation-identifier-tenderer"),
        "winner_country": first("winner-country"),
        "winner_countries": raw("winner-country"),
        "winner_sizes": raw("winner-size"),
        "award_date": iso_day(first("winner-decision-date")),
    }
    return parsed_notices(lines).select(*[expr.alias(name) for name, expr in columns.items()])
