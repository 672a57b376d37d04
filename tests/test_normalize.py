"""Normalization rules, envelopes and rejected records."""

from __future__ import annotations

import json

from edgetrail.operators.graph_rows import graph_rows
from edgetrail.operators.normalize import REQUEST_COLUMNS, normalize_requests, quarantine

BASE = {"timestamp": "2024-01-01T00:00:00+09:00", "request_uri": "/hls/v/1.ts", "status": "200", "request_id": "r"}


def one(logs, record, columns=None):
    rows = normalize_requests(logs(record), columns).collect()
    assert len(rows) == 1
    return rows[0]


def test_observed_address_is_kept(logs):
    row = one(logs, {**BASE, "client_ip": "192.168.0.151", "query_string": "token=sample&real_ip=10.0.0.9"})
    assert row["client_ip"] == "192.168.0.151"
    assert row["query_params"] == {"token": "sample", "real_ip": "10.0.0.9"}
    assert row["session_token"] == "sample"
    assert len(REQUEST_COLUMNS) == 46 and set(REQUEST_COLUMNS) <= set(row.asDict())


def test_api_token_event(logs):
    event = {
        "@timestamp": "2024-01-01T00:00:00.123Z", "request_method": "POST", "request_uri": "/api/playback/start",
        "query_string": "content_id=video_01&run_id=run-001", "cdn_token_id": "cdn_0123456789abcdef01234567",
        "status": 200, "token_valid": True, "token_ttl_sec": 1800, "request_id": "api-1",
    }
    row = graph_rows(logs(event)).first()
    assert (row["request_kind"], row["content_id"], row["cdn_token_id"], row["run_id"]) == (
        "playback_start", "video_01", "cdn_0123456789abcdef01234567", "run-001")
    assert row["token_valid"] is True and row["token_ttl_sec"] == 1800.0


def test_query_parameters(logs):
    row = one(logs, {**BASE, "query_string": "a=1&a=2&b&c=x%2By+z&d=%zz%41&=e&user%5Fid=7&&f=p=q"})
    assert row["query_params"] == {"a": "2", "b": "", "c": "x+y z", "d": "%zzA", "": "e", "user_id": "7", "f": "p=q"}
    assert row["account_id"] == "user_7"
    assert one(logs, BASE)["query_params"] == {}


def test_present_and_truthy_fallbacks(logs):
    row = one(logs, {
        **BASE, "query_string": "token=&user_id=&user=bob&sid=&run_id=&label=",
        "session_token": "s", "token_user_id": "9", "token_session_id": "-", "session_id": "x", "token_run_id": "r9",
        "token_dataset_label": "ds", "token_device_id": "", "device_id": "d9",
    })
    assert (row["session_token"], row["user_id"], row["account_id"]) == ("", "", "guest_bob")
    assert row["playback_session_id"] == "-"
    assert (row["run_id"], row["label"], row["dataset_label"], row["device_id"]) == ("", "", "ds", "d9")
    assert one(logs, {**BASE, "token_dataset_label": "ds"})["label"] == "ds"


def test_address_chain(logs):
    columns = ["client_ip"]
    assert one(logs, {**BASE, "client_ip": "-", "remote_addr": "-", "x_forwarded_for": "1.1.1.1 , 2.2.2.2"}, columns)["client_ip"] == "1.1.1.1"
    assert one(logs, {**BASE, "client_ip": "-", "remote_addr": "172.18.0.1"}, columns)["client_ip"] == "device_unknown"
    assert one(logs, {**BASE, "client_ip": "", "remote_addr": "3.3.3.3"}, columns)["client_ip"] == ""
    assert one(logs, BASE, columns)["client_ip"] == "-"


def test_numbers_and_alternates(logs):
    row = one(logs, {
        "timestamp": "2024-01-01T00:00:00Z", "url.original": "/x?y", "http.request.method": "PUT", "http.response.status_code": 404,
        "http.response.body.bytes": "77", "upstream_response_time": "0.1, 0.2", "http_connection": "Keep-Alive", "connection_requests": "x",
        "http_host": "h:1",
    })
    assert (row["content_path"], row["method"], row["status"], row["size"], row["response_time_ms"]) == ("/x?y", "PUT", 404, 77, 0.0)
    assert (row["keep_alive"], row["connection_requests"], row["domain"]) == (True, 0, "h:1")


def test_envelopes(logs):
    inner = {**BASE, "client_ip": "1.1.1.1", "http_user_agent": 'say "}{" \\ ok', "status": "201"}
    nested = {"@timestamp": "2024-02-01T00:00:00Z", "status": "202", "json": inner}
    message = {"@timestamp": "2024-02-01T00:00:00Z", "message": json.dumps(inner)}
    ignored = {**BASE, "message": json.dumps({"client_ip": "9.9.9.9", "request_uri": "/other"})}
    broken = {"timestamp": BASE["timestamp"], "message": "{not json"}
    columns = ["client_ip", "status", "user_agent", "timestamp", "content_path"]
    got = [tuple(r)[2:] for r in normalize_requests(logs(nested, message, ignored, broken, {**nested, "json": {}}), columns).orderBy("arrival").collect()]
    assert got[0] == ("1.1.1.1", 202, inner["http_user_agent"], "2024-02-01T00:00:00Z", "/hls/v/1.ts")
    assert got[1][:2] == ("1.1.1.1", 201) and got[1][3] == "2024-02-01T00:00:00Z"
    assert got[2][0] == "-" and got[2][4] == "/hls/v/1.ts"
    assert got[3][4] == "-"
    assert got[4][:2] == ("-", 202)


def test_rejected_records(logs):
    frame = logs(BASE, "{broken", {**BASE, "timestamp": "2024-13-45T99:00:00Z"}, {**BASE, "timestamp": "yesterday"})
    rows = normalize_requests(frame, ["timestamp"]).orderBy("arrival").collect()
    assert [r["timestamp"] for r in rows] == [BASE["timestamp"], "1970-01-01T00:00:00Z"]
    assert sorted(r["reason"] for r in quarantine(frame).collect()) == ["bad_timestamp", "malformed"]


def test_one_parse_and_small_scan(spark, logs, tmp_path):
    """The JSON text is parsed once, and eligibility is tested before the ids are built."""
    logs(BASE).write.parquet(str(tmp_path / "t"))
    rows = graph_rows(spark.read.parquet(str(tmp_path / "t")), ["cdn_token_id"])
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
    assert "token_label" not in plan
