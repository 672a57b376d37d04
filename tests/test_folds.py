"""Folds against a plain replay of the rows, and merging of batches."""

from __future__ import annotations

import random

import pytest

from edgetrail.operators.edges import belongs_to, edges_unified
from edgetrail.operators.graph_rows import graph_rows
from edgetrail.operators.nodes import NODE_FOLDS, nodes


def records(n: int, seed: int) -> list[dict]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.choice(["seg", "seg", "man", "start", "browse"])
        content = rng.choice(["video_01", "live_01", "v3"])
        other = rng.choice(["", "", "", "&content_id=v9"])
        path = {
            "seg": f"/hls/{content}/720p/s{rng.randint(1, 4)}.ts", "man": f"/hls/{content}/master.m3u8",
            "start": "/api/playback/start", "browse": f"/api/browse/content/{content}",
        }[kind]
        out.append({
            "timestamp": f"2024-01-01T00:00:{rng.randint(0, 9):02d}Z", "request_uri": path, "request_id": str(rng.randint(0, n)),
            "request_method": "POST" if kind == "start" else "GET", "status": rng.choice(["200", "200", "304", "404"]),
            "query_string": f"token=t{rng.randint(1, 3)}&run_id={rng.choice(['-', 'a', 'b'])}{other}",
            "token_ttl_sec": rng.choice(["0", "5", "7"]), "token_issued_at": rng.choice(["-", "x", "y"]),
            "bytes_sent": str(rng.randint(0, 50)), "client_ip": f"10.0.0.{rng.randint(1, 4)}",
        })
    return out


@pytest.fixture(scope="module")
def rows(spark):
    import json

    data = [(i, json.dumps(r)) for i, r in enumerate(records(160, 5))]
    return graph_rows(
        spark.createDataFrame(data, "arrival bigint, raw string")
    ).cache()


def test_sessions_against_replay(rows):
    expected: dict[str, dict] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["fold_ts"], r["arrival"])):
        s = expected.setdefault(r["viewing_session_id"], {
            "start_time": r["fold_ts"], "request_count": 0, "total_bytes": 0, "has_browse": False, "playback_without_browse": False,
            "token_ttl_sec": 0.0, "token_issued_at": None, "content_id": None, "is_live": False,
        })
        s["end_time"], s["run_id"] = r["fold_ts"], r["run_id"]
        s["request_count"] += 1
        s["total_bytes"] += r["bytes_sent"]
        if r["token_issued_at"] != "-":
            s["token_issued_at"] = r["token_issued_at"]
        if r["token_ttl_sec"] != 0:
            s["token_ttl_sec"] = r["token_ttl_sec"]
        if r["content_id"]:
            s["content_id"] = r["content_id"]
        s["is_live"] |= r["content_type"] == "live"
        if r["request_kind"] == "playback_start" and not s["has_browse"]:
            s["playback_without_browse"] = True
        s["has_browse"] |= r["request_kind"] == "browse_content"
    got = {r["viewing_session_id"]: r for r in nodes(rows, "ViewingSession").collect()}
    assert got.keys() == expected.keys()
    for key, want in expected.items():
        assert {k: got[key][k] for k in want} == want


def test_belongs_to_against_replay(rows):
    contents, expected = set(), set()
    for r in sorted(rows.collect(), key=lambda r: (r["fold_ts"], r["arrival"])):
        if r["content_id"]:
            contents.add(r["content_id"])
        if r["segment"] is not None and r["segment"]["content_id"] in contents:
            expected.add((r["segment"]["segment_id"], r["segment"]["content_id"]))
    assert {tuple(r) for r in belongs_to(rows).collect()} == expected


@pytest.mark.parametrize("label", list(NODE_FOLDS))
def test_merged_batches_equal_one_pass(rows, label):
    fold = NODE_FOLDS[label]
    parts = [fold.partial(rows.where(f"arrival % 3 = {i}")) for i in (2, 0, 1)]
    merged = fold.result(fold.merge(parts[0].unionByName(parts[1]).unionByName(parts[2])))
    whole = fold.apply(rows)
    assert merged.exceptAll(whole).count() == 0 and whole.exceptAll(merged).count() == 0


def test_replay_changes_no_node_or_edge_set(rows):
    twice = rows.unionByName(rows)
    assert edges_unified(twice).exceptAll(edges_unified(rows)).count() == 0
    for label in NODE_FOLDS:
        key = NODE_FOLDS[label].key
        assert nodes(twice, label).select(key).exceptAll(nodes(rows, label).select(key)).count() == 0
