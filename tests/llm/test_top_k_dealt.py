"""Blocks of vectors are dealt evenly over the tasks, and what is not read decides nothing."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from noticework.llm import topk


def test_every_task_searches_as_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 8)
    rng = np.random.default_rng(6)
    # 1203 vectors of one length, in parts that Spark makes as large as it likes.
    df = spark.createDataFrame([(i, [float(x) for x in rng.permutation(6)]) for i in range(1203)], "vec_id long, vector array<double>")
    met, lists = topk._met(df.filter("vec_id % 40 = 0"), df, 5, "vec_id", "vector")
    blocks = lists.count()
    held = {r[0]: r[1] for r in met.groupBy(F.spark_partition_id()).agg(F.countDistinct("block")).collect()}
    assert sum(held.values()) == blocks > 70
    assert len(held) == 3 * spark.sparkContext.defaultParallelism and max(held.values()) - min(held.values()) <= 1
    # Blocks and query blocks move once each, and no query block is left out.
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.count("shufflepartitionidpassthrough") == 2 and "hashpartitioning(task" not in plan
    asked = met.groupBy("block").agg(F.collect_list("query_ids").alias("asked")).collect()
    wanted = sorted(range(0, 1203, 40))
    assert all(sorted(np.concatenate([np.frombuffer(x, np.int64) for x in r["asked"]]).tolist()) == wanted for r in asked)


def test_blocks_out_of_reach_do_not_meet_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    # Six vectors outweigh all others for every query.
    df = spark.createDataFrame([(i, [1000.0 if i < 6 else 1.0, float(i % 3)]) for i in range(640)], "vec_id long, vector array<double>")
    met, lists = topk._met(df.filter("vec_id % 40 = 0"), df, 5, "vec_id", "vector")
    assert lists.count() >= 40 and met.select("block").distinct().count() <= 1


def test_nothing_unread_shows():
    lists, other = (topk.SortedLists(np.arange(6), np.array([[9.0], [8.0], [x], [2.0], [1.0], [-5.0]])) for x in (3.0, 4.0))
    for mine, theirs in zip(lists.read_to(2), other.read_to(2), strict=True):
        assert (mine == theirs).all()
    lowest, highest = lists.read_to(2)
    assert lowest[0].tolist() == [9, 8, -5, -5, -5, -5] and highest[0].tolist() == [9, 8, 8, 8, 8, 8]
    assert lowest[1].tolist() == [-9, -9, -9, -9, -1, 5] and highest[1].tolist() == [-1, -1, -1, -1, -1, 5]


def test_blocks_searched_before_raise_the_floors():
    def block(first, vectors):
        rows = pa.table({"id": pa.array(range(first, first + len(vectors)), pa.int64()), "vector": pa.array(vectors, pa.list_(pa.float64()))})
        return topk._block(rows, 0, first).to_pylist()[0]

    rng = np.random.default_rng(7)
    near, far = rng.integers(50, 90, (30, 3)).astype(float), rng.integers(1, 9, (30, 3)).astype(float)
    asked = block(1000, [[3.0, 1.0, 2.0], [1.0, 1.0, 1.0]])
    asked = {"asked": 1, "query_ids": asked["ids"], "queries": asked["vectors"], "query_width": asked["width"], "floors": np.array([1.0, 1.0]).tobytes()}
    met = pa.RecordBatch.from_pylist([{**{c: b[c] for c in ("block", "ids", "vectors", "width")}, **asked} for b in (block(0, far.tolist()), block(100, near.tolist()), block(200, far.tolist()))])
    found = [hits for *_, hits in topk._searches(iter([met]), 5)]
    assert [bool(hits[3].all()) for hits in found] == [True, True, False] and not found[2][3].any() and not len(found[2][0])
    assert len(found[0][0]) == len(found[1][0]) == 10


def test_best_scores_of_several_blocks():
    so_far = np.array([[5.0, 1.0, 3.0], [-np.inf, -np.inf, 2.0]])
    found = np.array([0, 0, 1, 1, 1]), np.arange(5), np.array([4, 2, 9, 8, 1]), np.zeros(2, np.int64)
    assert np.sort(topk._best_scores(so_far, found), axis=1).tolist() == [[3, 4, 5], [2, 8, 9]]
