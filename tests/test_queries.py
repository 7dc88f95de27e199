"""Registered queries next to their SQL on the smallest tables.

A quick selection runs by default; TAPELINE_ALL=1 runs every query.
"""

import os
from pathlib import Path

import pytest
from compare import compare, duck

from tapeline.catalog import load

SF = "/root/testdata/sf0.001"
QUICK = [
    "bars_1h", "structure_breaks", "order_blocks", "journal_run_metrics", "journal_equity_curve", "outcome_resolved", "join_asof_backward",
    "join_zone_overlap", "greedy_gap_dedup", "what_if_exits", "sample_folds", "rank_opportunities", "overfit_pbo", "drift_report", "source_window_replaced",
    "stream_breaker_status", "what_if_exit_combos", "what_if_accepted_variants", "portfolio_breaker_windows", "portfolio_pause_run", "journal_class_rollup",
]
QUERIES, SQL = load()
NAMES = list(QUERIES) if os.environ.get("TAPELINE_ALL") else QUICK

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables absent")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    message = compare(spark, con, name, QUERIES[name], SQL.get(name), SF)
    assert message in ("", "no rows"), message


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
