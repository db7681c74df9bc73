"""The registered queries on the driver's small tables: SQL where there is some, else brute force."""

import zlib
from pathlib import Path

import pytest

import corpus_pipeline
from noticework.llm.queries import ORACLES, QUERIES
from tests.llm.test_text_operators import SCHEMA, odd_documents
from tests.oracle import compare, connection

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], SF_DIR) is None


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_packing_query_uses_few_sequences(spark):
    rows = QUERIES["op2_packing"](spark, SF_DIR).collect()
    assert len({r["sequence_id"] for r in rows}) <= -(-sum(r["length"] for r in rows) // 1024) + 1


def test_simhash_query(spark):
    from tests.llm.test_text_operators import plain_components, plain_fingerprint
    rows = QUERIES["op6_simhash"](spark, SF_DIR).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    items = [(r["doc_id"], plain_fingerprint(texts[r["doc_id"]])) for r in rows]
    assert [int(r["fingerprint"], 16) for r in rows] == [f for _, f in items]
    assert [r["component_id"] for r in rows] == plain_components(items)


def test_sharding_query(spark):
    rows = QUERIES["op7_sharding"](spark, SF_DIR).collect()
    for s in range(8):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots))) and abs(len(slots) - len(rows) / 8) < 1
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        raw = texts[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


def run_stages(spark, docs):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        made = stage(spark, docs, SF_DIR)
        docs = spark.createDataFrame(made.collect(), made.schema)
        assert name == "packing" or docs.columns == columns
        out.append(docs)
    return out


def test_stages_on_odd_documents(spark):
    kept, deduped, unique, mixed, packed = run_stages(spark, odd_documents(spark))
    assert {r["doc_id"] for r in mixed.collect()} == {r["doc_id"] for r in unique.collect()}
    assert packed.count() >= mixed.count() > 0
    assert kept.count() == deduped.count() >= unique.count()


def test_one_document_of_each_group_without_numbers(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(None, text, "en", "s", 0), (None, text + " end", "en", "s", 0), (7, "other words stand here", "en", "s", 0), (7, text.replace("w", "v"), "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = corpus_pipeline.near_dedup(spark, docs, SF_DIR).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["7", "7", "None"]


def test_stages_on_nothing(spark):
    assert all(df.count() == 0 for df in run_stages(spark, spark.createDataFrame([], SCHEMA)))


def test_whole_pipeline(spark):
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert len({r["doc_id"] for r in rows}) > 100
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "simhash near-dedup", "mixing", "packing"]
