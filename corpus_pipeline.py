"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticework.llm.common import fresh, table
from noticework.llm.lines import dedup_lines
from noticework.llm.mixing import mix
from noticework.llm.packing import pack
from noticework.llm.quality import judge_documents
from noticework.llm.simhash import near_duplicates
from noticework.session import scratch_path

# No source is repeated more than this many times as often as the largest one.
MAX_REPETITION = 2.0

# SimHash and Kneser-Ney models are not expressible in SQL; tests use brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie inside their language's perplexity band."""
    prefix = fresh(docs, "judged_")
    return judge_documents(docs, prefix=prefix).filter(F.col(prefix + "kept")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document holds; ``n_chars`` follows the text."""
    before, dropped = fresh(docs, "lines_before"), fresh(docs, "lines_dropped")
    cleaned = dedup_lines(docs, n_lines=before, n_dropped=dropped)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest number."""
    mark, component, root = fresh(docs, "simhash"), fresh(docs, "group_first"), fresh(docs, "group_root")
    found = near_duplicates(docs, fingerprint_name=mark, component=component, root_name=root)
    # Missing and repeated numbers may leave a group several smallest documents; one of them stays.
    return found.filter(F.col("doc_id").eqNullSafe(F.col(component))).dropDuplicates([root]).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the tempered mix: every one at least once, those of small sources up to twice."""
    return mix(docs, max_repetition=MAX_REPETITION, seed=8, prefix=fresh(docs, "mixed_")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and place."""
    return pack(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("simhash near-dedup", near_dedup), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each result is written down and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = scratch_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
