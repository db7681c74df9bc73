"""Readers: everything arrives as text under a declared schema, types come later."""

from __future__ import annotations

import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


# One dialect for reading and writing: quotes are doubled, blanks at either end of a text are part of it,
# an empty text is read as a missing one.
CSV_DIALECT = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
# The month in a file's own name, as the last part of its path.
MONTH_OF_FILE = r"(\d{4}-\d{2})[^/]*$"
# Headers read at a time: each is a job over one line, one per layout.
HEADERS_AT_ONCE = 16


def text_schema(columns: Sequence[str]) -> StructType:
    return StructType([StructField(name, StringType()) for name in columns])


def read_text_csv(spark: SparkSession, path: str | list[str], columns: Sequence[str], file_column: str | None = None,
                  line_breaks: bool | None = None) -> DataFrame:
    """CSV with a header, every column kept as text (codes keep their leading zeros).

    ``columns`` must follow the file order; with ``enforceSchema`` off Spark checks them against each header.  Quoted
    texts may hold line breaks, which ties a file to one task.  ``line_breaks`` says whether any do; by default one
    pass over the lines finds the files that may, and Spark splits the others.
    """
    if line_breaks is None:
        files = _files(spark, path)
        broken = {file for file, (_, breaks) in survey_files(spark, files).items() if breaks}
        parts = [read_text_csv(spark, some, columns, file_column, breaks) for breaks in (False, True) if (some := [f for f in files if (f in broken) is breaks])]
        return _united(parts)
    df = spark.read.schema(text_schema(columns)).options(**CSV_DIALECT).option("enforceSchema", False).option("multiLine", line_breaks).csv(path)
    return df if file_column is None else df.withColumn(file_column, F.col("_metadata.file_path"))


def _spelled(file: str) -> str:
    """A file's address in one spelling: Spark escapes it, and writes an empty authority in two ways."""
    return re.sub("^([A-Za-z0-9+.-]+):///", r"\1:/", unquote(file))


def _files(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    """The files behind paths, folders and globs."""
    return [_spelled(file) for file in spark.read.text(path if isinstance(path, str) else list(path)).inputFiles()]


def survey_files(spark: SparkSession, files: Sequence[str]) -> dict[str, tuple[str, bool]]:
    """First line of each file that has one, and whether a quoted text may go on in the next line: one job for all files.

    A text with a line break leaves its first line with an odd number of quotes.  A stray quote looks the same, which
    only costs the split.
    """
    value = F.col("value")
    lines = spark.read.text(list(files)).select("value", "_metadata.file_path", "_metadata.file_block_start")
    quotes = F.length("value") - F.length(F.replace(value, F.lit('"'), F.lit("")))
    first = F.when((F.col("file_block_start") == 0) & (F.trim(value) != ""), value)
    found = lines.groupBy("file_path").agg(F.first(first, ignorenulls=True).alias("header"), F.bool_or(quotes % 2 == 1).alias("breaks")).collect()
    return {_spelled(r["file_path"]): (r["header"] or "", r["breaks"]) for r in found}


def _united(parts: list[DataFrame]) -> DataFrame:
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part, allowMissingColumns=True)
    return table


def _header(spark: SparkSession, path: str) -> tuple[str, ...]:
    return tuple(spark.read.options(**CSV_DIALECT).option("inferSchema", False).csv(path).columns)


def _by_layout(spark: SparkSession, path: str | Sequence[str], file_column: str | None, line_breaks: bool | None) -> DataFrame:
    """Files of any headers as one table: files with the same header are read together, columns are united by name."""
    files = _files(spark, path)
    surveyed = survey_files(spark, files)
    # One file tells the column names of all files with its first line.
    examples = {surveyed.get(file, ("", False))[0]: file for file in files}
    with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:
        names = dict(zip(examples, pool.map(lambda file: _header(spark, file), examples.values()), strict=True))
    layouts: dict[tuple[tuple[str, ...], bool], list[str]] = {}
    for file in files:
        header, breaks = surveyed.get(file, ("", False))
        layouts.setdefault((names[header], breaks if line_breaks is None else line_breaks), []).append(file)
    return _united([read_text_csv(spark, some, header, file_column, breaks) for (header, breaks), some in layouts.items()])


def read_text_csv_by_header(spark: SparkSession, path: str | list[str], line_breaks: bool | None = None) -> DataFrame:
    """CSV whose headers name the columns, all text, no sampling pass over the data.

    Each file keeps its own header, so files may order their columns differently or lack some.  ``line_breaks`` as in
    ``read_text_csv``.
    """
    return _by_layout(spark, path, None, line_breaks)


def read_tsv(spark: SparkSession, path: str, columns: Sequence[str], wanted: dict[str, str]) -> DataFrame:
    """Tab-separated text without quoting; ``wanted`` maps file columns to short names."""
    df = (spark.read.schema(text_schema(columns)).option("header", True).option("sep", "\t").option("quote", "")
          .option("enforceSchema", False).csv(path))
    return df.select(*[F.col(f"`{name}`").alias(short) for name, short in wanted.items()])


def read_parquet(spark: SparkSession, path: str | list[str], merge: bool = False) -> DataFrame:
    """Parquet file, directory or glob; ``merge`` unites files whose columns differ."""
    paths = [path] if isinstance(path, str) else path
    return spark.read.option("mergeSchema", merge).parquet(*paths)


def read_run_files(spark: SparkSession, paths: Sequence[str], run_pattern: str, columns: Sequence[str]) -> DataFrame:
    """Many CSV files as one table: run name taken from the file's path, missing columns NULL.

    Files with the same header are read together, so the plan grows with the number of
    layouts and not with the number of files.
    """
    table = _by_layout(spark, paths, "__file", None)
    for name in columns:
        if name not in table.columns:
            table = table.withColumn(name, F.lit(None).cast("string"))
    run = F.regexp_extract("__file", run_pattern, 1)
    return table.withColumn("run", run).select("run", *[c for c in columns if c != "run"])


def month_of_file(pattern: str = MONTH_OF_FILE) -> Column:
    """The month that a file's path carries."""
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)


def read_page_lines(spark: SparkSession, path: str | list[str], spread: int | None = None, month_pattern: str = MONTH_OF_FILE) -> DataFrame:
    """Raw response pages, one JSON document per line, with the month of their file.

    Compressed files cannot be split; ``spread`` deals their lines out over that many tasks
    before the expensive parsing.
    """
    lines = spark.read.text(path).select(F.col("value").alias("page"), month_of_file(month_pattern).alias("month"))
    return lines if spread is None else lines.repartition(spread)
