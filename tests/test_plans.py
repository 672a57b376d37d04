"""Shapes of the physical plans: one parse, no nested loops, early limits, pruned scans."""

from __future__ import annotations

import pytest

from edgetrail.operators import correlation, reports
from edgetrail.plans import QUERIES, graph_queries
from edgetrail.session import materialize

SF_DIR = "/root/testdata/sf0.001"
PARSE = "inline(array(from_json"


def planned(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    return df, df._jdf.queryExecution().executedPlan().toString()


def final(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


@pytest.mark.parametrize(
    "name", ["token_fanout", "suspicious_sessions", "ip_correlation", "ip_paths", "graph_edges", "blocked_by_range", "edge_choice", "client_address_check", "favorites"]
)
def test_no_nested_loops_or_python(spark, name):
    _, plan = planned(spark, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoop", "EvalPython", "PythonUDF"):
        assert bad not in plan


@pytest.mark.parametrize("name", ["token_fanout", "token_fanout_members", "suspicious_sessions", "viewing_sessions", "graph_edges", "window_metrics", "ip_paths", "ip_correlation"])
def test_log_is_parsed_once(spark, monkeypatch, name):
    """Once over all plans that run: those of written tables, and the last one."""
    plans = []

    def recorded(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, *args)

    for module in (correlation, graph_queries, reports):
        monkeypatch.setattr(module, "materialize", recorded)
    df, _ = planned(spark, name)
    assert sum(p.count(PARSE) for p in [*plans, final(df)]) == 1


def test_one_shuffle_per_fold(spark):
    _, plan = planned(spark, "viewing_sessions")
    assert plan.count("Exchange hashpartitioning") == 1
    _, plan = planned(spark, "watch_history")
    assert plan.count("Exchange hashpartitioning") <= 3


def test_limits_come_before_the_shuffle(spark):
    df, _ = planned(spark, "newest_sessions")
    assert "WindowGroupLimit" in final(df)
    df, _ = planned(spark, "sessions_page")
    assert "TakeOrderedAndProject" in final(df)


def test_filters_and_columns_reach_the_scan(spark):
    _, plan = planned(spark, "newest_audit_rows")
    assert "value" not in plan[plan.index("ReadSchema") :]
    _, plan = planned(spark, "user_profile")
    assert "PushedFilters: [IsNotNull(c_custkey), EqualTo(c_custkey,7)]" in plan
