"""Readers and writers."""

import gzip
import json

from pyspark.sql import functions as F

from noticework.sources import readers, writers


def test_text_csv_keeps_codes_and_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('cpv,title\n01000000,"two\nlines, one ""quote"""\n09000000,\n')
    rows = readers.read_text_csv(spark, str(tmp_path / "a.csv"), ["cpv", "title"]).collect()
    assert [tuple(r) for r in rows] == [("01000000", 'two\nlines, one "quote"'), ("09000000", None)]
    assert readers.read_text_csv_by_header(spark, str(tmp_path / "a.csv")).dtypes == [("cpv", "string"), ("title", "string")]


def test_tsv_has_no_quoting(spark, tmp_path):
    (tmp_path / "c.txt").write_text('BvDID\tNAME\tother\nFR1\tThe "Firm\tx\n')
    row = readers.read_tsv(spark, str(tmp_path / "c.txt"), ["BvDID", "NAME", "other"], {"BvDID": "bvdid", "NAME": "name"}).first()
    assert tuple(row) == ("FR1", 'The "Firm')


def test_run_files_unite_layouts(spark, tmp_path):
    (tmp_path / "labels_one.csv").write_text("cpv,primary\n01,a\n")
    (tmp_path / "labels_two.csv").write_text("cpv,primary,secondary\n01,b,c\n")
    paths = sorted(str(p) for p in tmp_path.glob("*.csv"))
    rows = readers.read_run_files(spark, paths, r"labels_(.*)\.csv$", ["cpv", "primary", "secondary", "confidence"]).orderBy("run").collect()
    assert [tuple(r) for r in rows] == [("one", "01", "a", None, None), ("two", "01", "b", "c", None)]


def test_pages_carry_their_month(spark, tmp_path):
    with gzip.open(tmp_path / "2024-05.jsonl.gz", "wt") as f:
        f.write(json.dumps({"notices": []}) + "\n")
    row = readers.read_page_lines(spark, str(tmp_path), spread=3).first()
    assert row["month"] == "2024-05" and row["page"] == '{"notices": []}'


def test_rerun_writes_only_new_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([("2024-01", 1)], "month string, n int")
    both = spark.createDataFrame([("2024-01", 9), ("2024-02", 2)], "month string, n int")
    writers.write_new_partitions(old, path, ["month"])
    assert writers.write_new_partitions(both, path, ["month"]).count() in (0, 1)
    got = {(r["month"], r["n"]) for r in spark.read.schema("n int, month string").parquet(path).collect()}
    assert got == {("2024-01", 1), ("2024-02", 2)}


def test_union_by_name_and_append(spark, tmp_path):
    path = str(tmp_path / "log")
    writers.append_log(spark.createDataFrame([(1, "x")], "n int, a string"), path)
    writers.append_log(spark.createDataFrame([(2, 5)], "n int, b int"), path)
    got = readers.read_parquet(spark, path, merge=True)
    assert set(got.columns) == {"n", "a", "b"} and got.count() == 2
    stats = writers.file_statistics(got.withColumn("t", F.lit("x")), ["t"], "n").first()
    assert stats["n_rows"] == 2 and stats["notices"] == 2


def test_report_is_sorted(spark, tmp_path):
    path = str(tmp_path / "r")
    writers.write_report(spark.createDataFrame([(2, "b"), (1, "a")], "n int, s string"), path, ["n"])
    (part,) = [p for p in (tmp_path / "r").glob("part-*")]
    assert part.read_text() == "n,s\n1,a\n2,b\n"


def test_files_are_split_unless_a_text_goes_on_in_the_next_line(spark, tmp_path):
    folder = tmp_path / "with blank%20"
    folder.mkdir()
    (folder / "plain.csv").write_text('a,b\n01,"x ""y"""\n')
    (folder / "broken.csv").write_text('b,a\n"two\nlines",2\n')
    (folder / "stray.csv").write_text("a,c\n5 \" pipe,z\n")
    (folder / "empty.csv").write_text("")
    files = readers._files(spark, str(folder))
    surveyed = {f.rsplit("/", 1)[1]: found for f, found in readers.survey_files(spark, files).items()}
    assert surveyed == {"plain.csv": ("a,b", False), "broken.csv": ("b,a", True), "stray.csv": ("a,c", True)}
    rows = readers.read_text_csv_by_header(spark, str(folder)).select("a", "b", "c").collect()
    assert sorted(map(tuple, rows)) == [("01", 'x "y"', None), ("2", "two\nlines", None), ('5 " pipe', None, "z")]
    declared = readers.read_text_csv(spark, [str(folder / "plain.csv")], ["a", "b"])
    assert [tuple(r) for r in declared.collect()] == [("01", 'x "y"')]


def test_a_large_file_without_line_breaks_has_many_tasks(spark, tmp_path):
    (tmp_path / "large.csv").write_text("a,b\n" + "".join(f"{i},text\n" for i in range(200_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "262144")
    try:
        df = readers.read_text_csv_by_header(spark, str(tmp_path / "large.csv"))
        assert df.rdd.getNumPartitions() > 4 and df.count() == 200_000 and df.filter("a = 'a'").isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
