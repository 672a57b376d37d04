"""Every registered query against its check SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from edgetrail.plans import QUERIES, inputs
from compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"
# Queries whose rule finds nothing in the smallest tables.
MAY_BE_EMPTY = {"sessions_page", "token_ip_count", "rate_limit_report", "user_history", "user_favorites", "suspicious_sessions", "user_sessions"}


@pytest.fixture(scope="module")
def duck():
    con = connect(SF_DIR)
    yield con
    con.close()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    query, sql = entry.queries()[name], entry.oracle_sql()[name]
    problem = difference(spark, duck, query, sql, SF_DIR)
    if name in MAY_BE_EMPTY and problem == "both sides are empty":
        return
    assert problem is None


@pytest.mark.parametrize("name", ["api_events", "favorite_actions", "user_actions", "token_payloads"])
def test_inputs_cover_all_events(duck, name):
    assert duck.sql(f"SELECT count(*) FROM ({inputs.SQL[name]})").fetchall() == duck.sql("SELECT count(*) FROM events").fetchall()


def test_manifest_covers_all_users(duck):
    got = duck.sql(f"SELECT count(*), count(DISTINCT string_split(run_id, '-')[2]) FROM ({inputs.SQL['run_manifest_text']})").fetchall()
    assert got == duck.sql("SELECT count(DISTINCT (user_id, day(ts))), count(DISTINCT user_id) FROM events").fetchall()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
