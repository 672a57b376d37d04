"""Fan-out flags, percentiles, the block list, hops and set similarity against brute force."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgetrail.operators import blocklist, joins, reports
from edgetrail.operators.correlation import ip_paths, ip_reach
from edgetrail.operators.similarity import similar_sets
from edgetrail.plans import QUERIES

SF_DIR = "/root/testdata/sf0.001"

PLAIN = {"ip": "client_ip", "account": "account_id", "content": "content_id", "referrer": "referrer_domain"}


@pytest.fixture()
def shared_sessions(spark):
    """Rows in which tokens have one or several sessions, and one session has many addresses."""
    rnd = random.Random(8)
    rows = []
    for _ in range(500):
        s = rnd.randint(0, 25)
        ip = f"10.0.0.{rnd.randint(0, 60)}" if s == 0 else f"10.0.0.{s % 5}"
        token = rnd.choice([f"t{s}", f"t{s // 2}", "", f"u{rnd.randint(0, 9)}"])
        rows.append((f"s{s}", token, rnd.choice(["-", "", f"a{s % 3}"]), f"c{s % 4}", ip, f"r{s % 2 if s > 20 else 0}"))
    rows += [("x", "tx", "-", "", "-", "r0"), ("x", "tx", "-", "", "", "r0")]
    return rows, spark.createDataFrame(rows, "viewing_session_id string, cdn_token_id string, account_id string, content_id string, client_ip string, referrer_domain string")


def test_fanout_by_brute_force(shared_sessions, monkeypatch):
    rows, df = shared_sessions
    members, sessions = defaultdict(set), defaultdict(set)
    for s, token, account, content, ip, referrer in rows:
        if token:
            sessions[token].add(s)
        for kind, value in (("account", account), ("content", content), ("ip", ip), ("referrer", referrer)):
            if value and not (value == "-" and kind != "content"):
                members[s].add((kind, value))
    unions = {t: set().union(*(members[s] for s in ss)) for t, ss in sessions.items()}
    count = lambda t, kind: sum(k == kind for k, _ in unions[t])
    flagged = {t for t in unions if count(t, "ip") > 2 or count(t, "referrer") > 1}
    assert 0 < len(flagged) < len(unions)
    for hot in (joins.HOT_ROWS, 3):
        monkeypatch.setattr(joins.join_on_summary, "__defaults__", (hot,))
        got = {(r["token"], *(r[f"{k}_count"] for k in ("account", "content", "ip", "referrer"))) for r in reports.token_fanout(df).collect()}
        assert got == {(t, *(count(t, k) for k in ("account", "content", "ip", "referrer"))) for t in flagged}
        assert {tuple(r) for r in reports.token_fanout_members(df).collect()} == {(t, k, v) for t in flagged for k, v in unions[t]}
        bad = {s for t in flagged for s in sessions[t]}
        assert {tuple(r) for r in reports.suspicious_sessions(df).collect()} == {(s, v) for s in bad for k, v in members[s] if k == "ip"}


def test_order_statistics_are_exact(spark):
    rnd = random.Random(6)
    values = {k: [rnd.choice([rnd.randint(-50, 50), rnd.randint(0, 10**9), 7]) for _ in range(n)] for k, n in (("a", 1), ("b", 2), ("c", 101), ("d", 400))}
    values["e"] = [5] * 30
    rows = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v bigint")
    shares = [0.0, 0.5, 0.95, 0.99, 1.0]
    got = {(r["k"], r["share"]): r["percentile"] for r in reports.order_statistics(rows.groupBy("k", "v").agg(F.count("*").alias("n")), "k", "v", shares).collect()}
    assert len(got) == len(values) * len(shares)
    for (k, share), found in got.items():
        assert found == pytest.approx(np.percentile(values[k], share * 100), rel=1e-12)


def test_window_metrics_without_delays(spark):
    at = datetime(2024, 1, 1)
    rows = [(at, at + timedelta(milliseconds=40), 5, 200, "HIT"), (at, at + timedelta(milliseconds=41), 5, 404, "MISS"), (at + timedelta(hours=2), None, 1, 200, "-")]
    df = spark.createDataFrame(rows, "event_ts timestamp, ingest_ts timestamp, size bigint, status bigint, cache_status string")
    first, later = reports.window_metrics(df).orderBy("window_start").collect()
    assert (first["requests"], first["delay_p50_ms"], first["lag_ms"], first["cache_hit_ratio"]) == (2, 40.5, 41, 0.5)
    assert (later["requests"], later["delay_p50_ms"], later["cache_hit_ratio"]) == (1, None, None)


@pytest.mark.parametrize("words", [1, 1 << 17])
def test_blocked_rows_by_brute_force(spark, monkeypatch, words):
    monkeypatch.setattr(blocklist, "FILTER_WORDS", words)  # one word lets nearly every key through
    rnd = random.Random(9)
    text = lambda p, n: rnd.choice([None, "", *(f"{p}{i}" for i in range(n))])
    rows = [(i, text("ip", 40), text("t", 40), text("t", 40), text("r", 40)) for i in range(300)] + [(0, "ip1", None, None, None)] * 3
    listed = [("ips", f"ip{i}") for i in range(0, 40, 9)] + [("tokens", f"t{i}") for i in range(0, 40, 11)] + [("referers", "r3"), ("ips", "t1"), ("other", "ip2"), ("ips", None), ("ips", "ip0")]
    df = spark.createDataFrame(rows, "n int, remote_addr string, http_x_session_token string, log_session_token string, referer string")
    on = set(listed)
    want = sorted((n, ("ips", a) in on and a is not None or any(("tokens", t) in on for t in (b, c)) or ("referers", d) in on) for n, a, b, c, d in rows)
    got = blocklist.blocked_flag(df, spark.createDataFrame(listed, "type string, value string"))
    assert sorted((r["n"], r["blocked"]) for r in got.collect()) == want and got.columns == [*df.columns, "blocked"]
    assert blocklist.blocked_flag(df, spark.createDataFrame([], "type string, value string")).where("blocked").count() == 0


def test_hops_from_many_starts(spark):
    rnd = random.Random(3)
    seen = {(f"t{rnd.randint(0, 120)}", f"10.0.0.{rnd.randint(0, 150)}") for _ in range(330)}
    rows = spark.createDataFrame([(ip, t, "r", datetime(2024, 1, 1)) for t, ip in seen], "client_ip string, cdn_token_id string, referrer_domain string, fold_ts timestamp")
    by_token, by_ip = defaultdict(set), defaultdict(set)
    for t, ip in seen:
        by_token[t].add(ip)
        by_ip[ip].add(t)
    starts = [f"10.0.0.{i}" for i in range(0, 150)] + ["unknown"]
    want = set()
    for start in starts:
        known = frontier = {start}
        for hop in (1, 2, 3):
            frontier = {ip for f in frontier for t in by_ip[f] for ip in by_token[t]} - known
            want |= {(start, ip, hop) for ip in frontier}
            known = known | frontier
    frame = spark.createDataFrame([(s,) for s in starts + starts[:5]], "ip string")
    assert {tuple(r) for r in ip_paths(rows, frame, 3).collect()} == want
    bits, _ = ip_reach(rows, frame, 3)
    assert bits.agg(F.sum(F.bit_count("bits"))).first()[0] == len(want)


@pytest.mark.parametrize(("least", "hot_group"), [(0.5, 3), (0.3, 6), (0.8, 2000)])
def test_similar_sets_by_brute_force(spark, least, hot_group):
    rnd = random.Random(7)
    sets = {f"k{i:03d}": {f"i{min(int(rnd.expovariate(0.25)), 30)}" for _ in range(rnd.randint(1, 9))} | ({"all"} if i % 3 else set()) for i in range(50)}
    sets |= {f"z{i}": {"all", f"own{i}"} for i in range(12)} | {"y1": {"all"}, "y2": {"all"}}
    df = spark.createDataFrame([(k, x) for k, s in sets.items() for x in s] + [(None, "all"), ("k000", None)], "key string, item string")
    classes, pairs = similar_sets(df, least, hot_group)
    rep = {k: min(o for o, s in sets.items() if s == own) for k, own in sets.items()}
    assert {tuple(r) for r in classes.collect()} == {(k, rep[k], len(s)) for k, s in sets.items()}
    want = {}
    for a, b in combinations(sorted(set(rep.values())), 2):
        n = len(sets[a] & sets[b])
        if n / (len(sets[a] | sets[b])) >= least - 1e-9:
            want[a, b] = n
    assert {(r["cls1"], r["cls2"]): r["shared"] for r in pairs.collect()} == want


@pytest.mark.parametrize(("name", "most"), [("token_fanout", 6), ("token_fanout_members", 3), ("suspicious_sessions", 3)])
def test_exchanges_of_the_fanout(spark, name, most):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= most
