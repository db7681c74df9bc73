"""Helpers of the operators in this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# White space of the word and line contracts.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"
# Texts go to Python in batches of about so many bytes: a batch is held several times on its way, once per core.
BATCH_BYTES = 2 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose rows Spark will hand to Python by their bytes and not only by their number, unless the session has a limit of its own."""
    if df.sparkSession.conf.get(BATCH_SETTING, None) is None:
        df.sparkSession.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df


def with_arrow(df: DataFrame, inputs: list[str], outputs: StructType,
               compute: Callable[..., list[pa.Array]], keep: Iterable[str] | None = None) -> DataFrame:
    """``df``'s columns ``keep`` (default all) and the ones ``compute`` makes from ``inputs``, batch by batch."""
    kept = list(df.columns if keep is None else keep)
    read = list(dict.fromkeys([*kept, *inputs]))
    schema = StructType([*(df.schema[c] for c in kept), *outputs.fields])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = compute(*(batch.column(read.index(c)) for c in inputs))
            yield pa.RecordBatch.from_arrays([*(batch.column(read.index(c)) for c in kept), *made], names=names)

    return in_small_batches(df.select(*read)).mapInArrow(run, schema)


def word_count(text: Column) -> Column:
    """Number of words, white space being blank, tab and the line ends; null has none."""
    trimmed = F.trim(F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS)))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " +"))).cast("bigint")
