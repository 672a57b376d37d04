"""Rules that the registered queries do not reach, and brute-force checks on small rows."""

from __future__ import annotations

import hashlib
import hmac
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from edgetrail.operators import accounts, blocklist, correlation, joins, quality, reports, tokens


@pytest.mark.parametrize("secret", ["k", "x" * 100])
def test_hmac(spark, secret):
    texts = ["", "abc", "한글", "y" * 300]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokens.hmac_sha256(secret, F.col("t")).alias("h")).collect()
    for r in rows:
        assert r["h"] == hmac.new(secret.encode(), r["t"].encode(), hashlib.sha256).hexdigest()


@pytest.mark.parametrize("hot", [1, 4, 1000])
def test_favorites_with_hot_keys(spark, monkeypatch, hot):
    rng = random.Random(3)
    actions = [(i, rng.choice([1, 1, 1, 2, 3]), rng.randint(1, 3), rng.choice(["add", "remove"])) for i in range(200)]
    state = {}
    for seq, user, content, op in actions:
        if op == "remove":
            state.pop((user, content), None)
        else:
            state.setdefault((user, content), seq)
    frame = spark.createDataFrame(actions, "seq bigint, user_id int, content_id int, op string").withColumn("ts", F.timestamp_seconds("seq"))
    join = joins.join_on_summary
    monkeypatch.setattr(accounts, "join_on_summary", lambda *a: join(*a, hot_rows=hot))
    got = {(r["user_id"], r["content_id"]): int(r["s"]) for r in accounts.favorites(frame).withColumn("s", F.unix_seconds("created_at")).collect()}
    assert got == state


def test_block_list(spark):
    actions = spark.createDataFrame(
        [(1, "ips", "a", "add"), (2, "ips", "a", "remove"), (3, "ips", "b", "add"), (4, "bad", "c", "add"), (5, "tokens", "", "add")],
        "seq bigint, type string, value string, op string")
    reports_ = spark.createDataFrame([(6, ["z"], ["t"], [])], "seq bigint, blocked_ips array<string>, blocked_tokens array<string>, blocked_referers array<string>")
    state = blocklist.blacklist_state(actions.unionByName(blocklist.expand_policy_reports(reports_)))
    assert {tuple(r) for r in state.collect()} == {("ips", "b"), ("ips", "z"), ("tokens", "t")}
    requests = spark.createDataFrame(
        [("b", "", "-", "r"), ("x", "", "t", "r"), ("x", "t", "-", "r"), ("x", "", "-", "r")],
        "remote_addr string, http_x_session_token string, log_session_token string, referer string")
    assert blocklist.blocked_flag(requests, state).where("blocked").count() == 3


def test_blocked_ranges(spark):
    ips = ["10.0.0.1", "10.0.1.1", "192.168.5.9", "x", "255.255.255.255"]
    requests = spark.createDataFrame([(i,) for i in ips], "client_ip string")
    ranges = spark.createDataFrame([("10.0.0.0/23",), ("192.168.5.9",), ("bad/99",)], "cidr string")
    got = {r["client_ip"] for r in blocklist.blocked_by_range(requests, ranges).collect()}
    assert got == {"10.0.0.1", "10.0.1.1", "192.168.5.9"}


def test_zero_duration_and_percent(spark):
    rows = spark.createDataFrame([(1, 1, "s", 9, 0, 1, 1, 1), (1, 2, "s", 45, 50, 1, 1, 1)],
        "user_id int, content_id int, session_token string, watch_duration int, total_duration int, ts int, seq1 int, seq2 int")
    got = {r["content_id"]: (r["progress_percent"], r["completed"]) for r in accounts.watch_history(rows).collect()}
    assert got == {1: (None, None), 2: (90.0, True)}
    assert reports.block_rate(spark.createDataFrame([(0, 0)], "total bigint, blocked bigint")).first()["block_rate"] == 0.0


def test_replay_difference(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z")], "k int, v string")
    assert quality.replay_difference(a, a).count() == 0
    assert {(r["v"], r["side"]) for r in quality.replay_difference(a, b).collect()} == {("y", "first"), ("z", "second")}


def test_replay_summary(spark):
    schema = "k string, v string, n long, m long"
    once = spark.createDataFrame([("a", "x", 1, 0), ("b", None, 2, 3), (None, "z", 5, None), ("gone", "x", 1, 1)], schema)
    twice = spark.createDataFrame([("a", "x", 2, 0), ("b", "y", 4, 6), (None, "z", 10, None), ("new", "x", 2, 2)], schema)
    assert tuple(quality.replay_summary(once, twice, "k", ["n", "m"]).first()) == (4, 3, 3)
    assert tuple(quality.replay_summary(once.select("k", "v"), once.select("k", "v"), "k").first()) == (4, 0, 0)
    assert tuple(quality.replay_summary(once.limit(0), twice.limit(0), "k", ["n"]).first()) == (0, 0, 0)


def test_date_times(spark):
    good = ["2024-02-29T23:59:60Z", "2024-01-01t00:00:00.123+09:00", "0001-01-01T00:00:00z"]
    bad = ["", "2024-01-01", "2023-02-29T00:00:00Z", "2024-13-01T00:00:00Z", "2024-01-01T24:00:00Z", "2024-01-01T00:00:00", "2024-01-01 00:00:00Z", "2024-01-01T00:00:00+24:00", "x2024-01-01T00:00:00Z"]
    rows = spark.createDataFrame([(t,) for t in [*good, *bad, None]], "t string").select("t", quality.is_date_time(F.col("t")).alias("ok")).collect()
    assert {r["t"]: r["ok"] for r in rows} == {**dict.fromkeys(good, True), **dict.fromkeys(bad, False), None: None}


def test_broadcast_only_when_small(spark):
    df = spark.range(100)
    assert "hint" in joins.broadcast_if_small(df, 100)._jdf.queryExecution().analyzed().toString().lower()
    assert joins.broadcast_if_small(df, 99) is df


def test_manifest_rules(spark):
    schema = ("run_id string, schema_version int, dataset_prefix string, scenario_id string, attack_family string, seed bigint, status string, "
              "logical_client_ids array<string>, parameters map<string,string>, expected_request_count bigint, observed_request_count bigint")
    good = ("run-0001", 1, "tnsm_100lc_20240101_a", "N1", None, 0, "failed", ["lc001"], {}, None, 0)
    bad = ("short", 2, None, "B1", "M6", -1, None, [], None, -1, -1)
    rows = quality.check_manifest(spark.createDataFrame([good, bad], schema)).collect()
    assert {r["run_id"] for r in rows} == {"short"} and len(rows) == 11


def _largest_output(df):
    """The most rows that any operator of the finished plan put out."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        rows = node.metrics().get("numOutputRows")
        most = max(most, rows.get().value() if rows.isDefined() else 0)
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return most


def test_fanout_of_a_run_with_many_tokens_and_addresses_makes_no_product(spark):
    n = 2000
    rows = spark.range(n).selectExpr(
        "'run' AS viewing_session_id", "concat('t', id) AS cdn_token_id", "'-' AS account_id", "'c' AS content_id",
        "concat('a', id) AS client_ip", "'r' AS referrer_domain",
    )
    counts = reports.token_fanout(rows)
    assert _largest_output(counts) <= 10 * n
    assert counts.where(f"ip_count = {n} AND referrer_count = 1 AND content_count = 1 AND account_count = 0").count() == n


def test_a_referrer_of_everyone_makes_no_address_pairs(spark):
    n = 500
    rows = spark.range(n).selectExpr(
        "concat('a', id) AS client_ip", "concat('t', greatest(id, 1)) AS cdn_token_id", "'r' AS referrer_domain",
        "TIMESTAMP '2024-01-01 00:00:00' AS fold_ts",
    )
    found = correlation.ip_correlation(rows, rows.select(rows.client_ip.alias("ip")))
    assert _largest_output(found) <= 10 * n
    pairs = [(r["ip1"], r["ip2"], r["shared_tokens"], r["shared_referers"], r["score"]) for r in found.orderBy("ip1").collect()]
    assert pairs == [("a0", "a1", 1, 1, 1.0), ("a1", "a0", 1, 1, 1.0)]


def test_resolve_sessions_in_one_join(spark):
    """Requests of an expired session, of a session without a user and without a token stay unresolved, each once."""
    sessions = spark.sql("""SELECT id, user_id, token AS session_token, 'r' || token AS refresh_token, active AS is_active, timestamp'2024-01-01' + make_interval(0, 0, 0, days) AS expires_at
      FROM VALUES (1, 1, 'a', true, 9), (2, 1, 'b', true, 1), (3, 2, 'c', false, 9), (4, 9, 'd', true, 9) t(id, user_id, token, active, days)""")
    users = spark.sql("SELECT id, 'm' || id AS email, 'n' || id AS username, 'free' AS subscription_plan FROM VALUES (1), (2) t(id)")
    asked = spark.sql("SELECT * FROM VALUES (1, 'a'), (2, 'a'), (3, 'b'), (4, 'c'), (5, 'd'), (6, null), (7, 'zz') t(request, session_token)")
    as_of = datetime(2024, 1, 5)
    found, missing = accounts.resolve_sessions(asked, sessions.drop("refresh_token"), users, as_of)
    assert sorted((r.request, r.user_id) for r in found.collect()) == [(1, 1), (2, 1)]
    assert sorted(r.request for r in missing.collect()) == [3, 4, 5, 6, 7] and missing.columns == ["session_token", "request"]
    refreshed = accounts.resolved_requests(asked.selectExpr("request", "'r' || session_token AS refresh_token"), sessions.drop("session_token"), users, as_of, "refresh_token")
    assert sorted((r.request, r.resolved) for r in refreshed.collect()) == [(i, i < 3) for i in range(1, 8)]
    plan = refreshed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2  # sessions with users, and requests with both
