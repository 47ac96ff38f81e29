"""Every registered query against its SQL twin."""

import pytest
from check_queries import compare, entry, oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle(SF)


@pytest.mark.parametrize("name", sorted(entry.catalog.QUERIES))
def test_query(spark, duck, name):
    verdict, n, _ = compare(spark, duck, SF, name)
    assert verdict in ("ok", "rows-only")
    assert n >= 0


#: Queries that SQL cannot express, each with the test that takes its place.
WITHOUT_SQL = {"quorum_adaptive"}  # a fixpoint over all arrivals: tests/test_feedback.py judges them one by one


def test_every_query_has_sql():
    assert set(entry.catalog.QUERIES) == set(entry.catalog.ORACLE) | WITHOUT_SQL


def test_entry(spark):
    assert entry.entry(spark).count() > 0


SPLIT = ["run_summary", "completion_cdf", "correction_history", "carve_ranges", "coverage_audit", "reputation_history",
         "lifecycle", "stall", "grant_accept_asof", "time_to_ready", "quorum_exact", "counter_deltas", "lease_expiries"]


@pytest.mark.parametrize("name", SPLIT)
def test_query_with_every_group_split(spark, duck, split_everything, name):
    assert compare(spark, duck, SF, name)[0] == "ok"
