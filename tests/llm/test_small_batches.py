"""Python gets long texts in batches of bounded bytes, so that a core's memory does not grow with the texts."""

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from noticework.llm.common import BATCH_BYTES, with_arrow


def test_batches_are_bounded_by_bytes(spark):
    texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("ten bytes "), 1000).alias("text"))
    size = StructType([StructField("size", LongType())])
    sizes = with_arrow(texts, ["text"], size, lambda x: [pa.array([x.nbytes] * len(x), pa.int64())], [])
    assert sizes.count() == 3000
    assert sizes.agg(F.max("size")).first()[0] < 2 * BATCH_BYTES
