"""Every registered query equals its SQL counterpart on the small tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from noticework.catalogue import ORACLES, QUERIES
from tests.oracle import compare, connection

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF_DIR) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", ["match_fuzzy", "prefix_longest_match", "pairwise_agreement", "densify_grid", "work_grid", "share_correlation_windows", "function_panel"])
def test_no_products_of_tables(spark, name):
    plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_only_needed_columns(spark):
    plan = entry.queries()["semi_children"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_tax" not in plan
    assert "PushedFilters: [IsNotNull(o_orderdate)" in plan


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
