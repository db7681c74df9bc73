"""The whole chain from raw files to product tables and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from noticework.plans import products, reports
from noticework.sources.pages import flatten_pages
from noticework.sources.readers import read_page_lines, read_parquet, read_text_csv_by_header
from noticework.sources.writers import write_product, write_report


@dataclass(frozen=True)
class Inputs:
    """Where the raw data lies: yearly CSV exports, monthly page files, monthly exchange rates."""

    calls: str | list[str]
    awards: str | list[str]
    pages: str | list[str]
    rates: str


def build_products(spark: SparkSession, inputs: Inputs, out: str, spread: int | None = None, line_breaks: bool | None = None) -> dict[str, DataFrame]:
    """Build and write every product table; later tables read the written earlier ones.

    Large exports are split over tasks where no quoted text holds a line break; ``line_breaks`` decides it for all files.
    """
    made: dict[str, DataFrame] = {}

    def keep(name: str, df: DataFrame) -> None:
        write_product(df, f"{out}/{name}")
        made[name] = read_parquet(spark, f"{out}/{name}")

    keep("raw_calls", read_text_csv_by_header(spark, inputs.calls, line_breaks))
    keep("raw_awards", read_text_csv_by_header(spark, inputs.awards, line_breaks))
    keep("award_rows", products.award_rows(made["raw_awards"]))
    keep("notice_cn", products.call_notices(made["raw_calls"]))
    keep("notice_can", products.award_notices(made["raw_awards"], made["award_rows"]))
    keep("award", products.awards_of(made["award_rows"], made["notice_can"]))
    keep("notice_api", flatten_pages(read_page_lines(spark, inputs.pages, spread)))
    rates = read_text_csv_by_header(spark, inputs.rates).selectExpr("currency", "month", "try_cast(rate AS double) AS rate")
    keep("notice_all", products.history(made["notice_cn"], made["notice_can"], made["notice_api"], rates))
    keep("award_api", products.page_awards(made["notice_api"], made["notice_all"]))
    return made


def write_quality_reports(tables: dict[str, DataFrame], out: str) -> None:
    """The coverage, competition, outlier and lag reports as small sorted CSV files."""
    every = {
        "coverage_country_year": (reports.field_coverage(tables["notice_all"]), ["type", "year", "country"]),
        "monthly_procedures": (reports.monthly_procedures(tables["notice_all"]), ["type", "country", "month"]),
        "winners_export": (reports.export_winners(tables["award"], tables["notice_can"]), ["year", "country"]),
        "winners_pages": (reports.page_winners(tables["notice_api"]), ["year", "country"]),
        "value_outliers": (reports.value_outliers(tables["notice_all"]), ["type", "year", "country"]),
        "publication_lag": (reports.publication_lag(tables["notice_all"]), ["type", "year", "country"]),
        "call_to_award": (reports.call_to_award(tables["notice_cn"], tables["notice_can"], tables["notice_all"]), ["source", "year", "country"]),
        "monthly_values": (reports.monthly_values(tables["notice_all"]), ["type", "country", "month", "contract_type"]),
    }
    for name, (df, order) in every.items():
        write_report(df, f"{out}/{name}", order)
