"""Sources and sinks: tables written to the shared folder in every supported form and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticework.catalogue.entities import order_pages
from noticework.catalogue.registry import query, table
from noticework.operators.ordering import keep_last
from noticework.session import scratch_path
from noticework.sources import readers, writers
from noticework.sources.pages import flatten_pages
from noticework.streaming.jobs import ingest_pages

# Folders that Spark names after a month, as the months of the files below them.
MONTH_FOLDER = r"of_month=(\d{4}-\d{2})/"


@query("csv_two_layouts", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang, source, md5(nullif(text, '')) AS text_md5, length(nullif(text, '')) AS n FROM documents""")
def csv_two_layouts(spark, sf_dir):
    """Whole texts with quotes and line breaks; half of the files order their columns differently and lack one."""
    work, docs = scratch_path(spark, "two-layouts"), table(spark, sf_dir, "documents")
    even = F.coalesce(F.col("doc_id") % 2, F.lit(0)) == 0
    writers.write_text_csv(docs.filter(even).select("doc_id", "lang", "source", "text"), f"{work}/one")
    writers.write_text_csv(docs.filter(~even).select("text", "source", "doc_id"), f"{work}/two")
    read = readers.read_text_csv_by_header(spark, [f"{work}/one", f"{work}/two"])
    return read.select("doc_id", "lang", "source", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n"))


@query("csv_declared_columns", """
SELECT lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS code, p_name, CAST(p_size AS VARCHAR) AS p_size, '  ' || p_type || ' "' AS padded FROM part""")
def csv_declared_columns(spark, sf_dir):
    """Codes keep their leading zeros, texts their blanks and quotes."""
    path = scratch_path(spark, "declared")
    code = F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("code")
    writers.write_text_csv(table(spark, sf_dir, "part").select(code, "p_name", "p_size", F.concat(F.lit("  "), "p_type", F.lit(' "')).alias("padded")), path, "gzip")
    return readers.read_text_csv(spark, path, ["code", "p_name", "p_size", "padded"], line_breaks=False)


@query("tsv_subset", """
SELECT 'C' || c_custkey AS company, 'The "' || c_name AS name FROM customer""")
def tsv_subset(spark, sf_dir):
    """Two of four tab-separated columns, quotes being plain characters."""
    path = scratch_path(spark, "tabs")
    rows = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), "c_custkey").alias("BvD ID"), "c_acctbal", F.concat(F.lit('The "'), "c_name").alias("NAME"), "c_mktsegment")
    rows.write.option("header", True).option("sep", "\t").option("quote", "").csv(path)
    return readers.read_tsv(spark, path, rows.columns, {"BvD ID": "company", "NAME": "name"})


@query("parquet_union_by_name", """
SELECT CAST(year(l_shipdate) AS INT) AS year, count(*) AS n, count(CASE WHEN year(l_shipdate) >= 1998 THEN l_tax END) AS with_tax,
       count(CASE WHEN year(l_shipdate) < 1998 THEN l_discount END) AS with_discount, round(sum(l_quantity), 2) AS quantity
FROM lineitem GROUP BY 1""")
def parquet_union_by_name(spark, sf_dir):
    """Products of two periods with different columns, read as one table."""
    work = scratch_path(spark, "periods")
    lines = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("year"), "l_quantity", "l_discount", "l_tax")
    late = F.coalesce(F.col("year") >= 1998, F.lit(False))
    writers.write_product(lines.filter(~late).drop("l_tax"), f"{work}/lines_early")
    writers.write_product(lines.filter(late).drop("l_discount"), f"{work}/lines_late")
    read = readers.read_parquet(spark, f"{work}/lines_*", merge=True)
    return read.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.count("l_tax").alias("with_tax"), F.count("l_discount").alias("with_discount"),
                                    F.round(F.sum("l_quantity"), 2).alias("quantity"))


def _write_pages(pages, path):
    """Gzipped page files, one folder per month."""
    pages.select("page", F.col("month").alias("of_month")).repartition("of_month").write.mode("append").partitionBy("of_month").option("compression", "gzip").text(path)


_PAGES_SQL = """
SELECT o_orderkey || f.mark AS pub_number, strftime(o_orderdate, '%Y-%m') AS month, f.form AS form_type, o_totalprice AS total_value, o_orderpriority AS procedure_type
FROM orders, (VALUES ('competition', '-C'), ('result', '-R')) f(form, mark)"""
_PAGE_COLUMNS = ["pub_number", "month", "form_type", "total_value", "procedure_type"]


@query("page_files", _PAGES_SQL)
def page_files(spark, sf_dir):
    """Gzipped JSON lines; a notice's month is the one of its file."""
    path = scratch_path(spark, "page-files")
    _write_pages(order_pages(spark, sf_dir), path)
    lines = readers.read_page_lines(spark, path, spread=spark.sparkContext.defaultParallelism, month_pattern=MONTH_FOLDER)
    return flatten_pages(lines).select(*_PAGE_COLUMNS)


@query("page_ingest", _PAGES_SQL)
def page_ingest(spark, sf_dir):
    """Streaming ingest in two runs: the second one parses only the files that came in between."""
    work, pages = scratch_path(spark, "page-ingest"), order_pages(spark, sf_dir)
    early = F.col("month") < "1998-01"
    for part in (early, ~early):
        _write_pages(pages.filter(part), f"{work}/pages")
        ingest_pages(spark, f"{work}/pages/*", f"{work}/notices", f"{work}/checkpoint", month_pattern=MONTH_FOLDER)
    return spark.read.option("basePath", f"{work}/notices").parquet(f"{work}/notices").withColumn("month", F.date_format("month", "yyyy-MM")).select(*_PAGE_COLUMNS)


@query("run_files", """
SELECT ['alpha', 'beta', 'gamma'][doc_id % 3 + 1] AS run, CAST(doc_id AS VARCHAR) AS doc_id, CAST(quality AS VARCHAR) AS quality,
       CASE WHEN doc_id % 3 > 0 THEN CAST(toxic AS VARCHAR) END AS toxic, CAST(NULL AS VARCHAR) AS comment
FROM labels""")
def run_files(spark, sf_dir):
    """Label runs named by their folder; a column that a run lacks is NULL."""
    work, labels = scratch_path(spark, "runs"), table(spark, sf_dir, "labels")
    layouts = {"alpha": ["doc_id", "quality"], "beta": ["doc_id", "quality", "toxic"], "gamma": ["toxic", "doc_id", "quality"]}
    for place, (name, columns) in enumerate(layouts.items()):
        writers.write_text_csv(labels.filter(F.col("doc_id") % 3 == place).select(*columns), f"{work}/run_{name}")
    files = spark.read.text([f"{work}/run_{name}" for name in layouts]).inputFiles()
    return readers.read_run_files(spark, files, r"/run_([a-z]+)/", ["doc_id", "quality", "toxic", "comment"])


@query("append_log_latest", """
SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS event_id, max_by(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2""")
def append_log_latest(spark, sf_dir):
    """Two appends to a log; the last row of a cell counts."""
    path, events = scratch_path(spark, "log"), table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    odd = F.coalesce(F.dayofmonth("ts") % 2, F.lit(0)) == 1
    writers.append_log(events.filter(odd), path)
    writers.append_log(events.filter(~odd), path)
    return keep_last(readers.read_parquet(spark, path), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("partition_rerun", """
SELECT CAST(CASE WHEN o_orderpriority <> '5-LOW' THEN year(o_orderdate) END AS INT) AS year,
       CAST(CASE WHEN o_orderpriority = '5-LOW' OR year(o_orderdate) < 1998 THEN 1 ELSE 2 END AS INT) AS version, count(*) AS n_rows, count(DISTINCT o_custkey) AS notices
FROM orders GROUP BY 1, 2""")
def partition_rerun(spark, sf_dir):
    """A rerun adds the partitions that are missing and leaves the finished ones, also the one without a value."""
    path = scratch_path(spark, "rerun")
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderpriority") != "5-LOW", F.year("o_orderdate")).alias("year"))
    writers.write_new_partitions(orders.filter("year is null or year < 1998").withColumn("version", F.lit(1)), path, ["year"])
    writers.write_new_partitions(orders.withColumn("version", F.lit(2)), path, ["year"])
    return writers.file_statistics(readers.read_parquet(spark, path), ["year", "version"], "o_custkey")


@query("sorted_report", """
SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority, CAST(count(*) AS VARCHAR) AS n FROM orders GROUP BY 1, 2""")
def sorted_report(spark, sf_dir):
    """An aggregated report as one sorted CSV file, read back as text."""
    path = scratch_path(spark, "report")
    counted = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    writers.write_report(counted, path, ["month", "o_orderpriority"])
    return readers.read_text_csv_by_header(spark, path)
