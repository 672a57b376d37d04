"""Column lists of the log shapes and the relational tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Keys of an edge access-log record; every value is text.
EDGE_LOG_FIELDS = """
timestamp client_ip client_region edge_server remote_addr x_forwarded_for request_method uri request_uri
query_string status bytes_sent response_time_ms token_user_id token_session_id token_content_id
token_issued_at token_expires token_ttl_sec token_ttl_remaining_sec token_valid token_edge_match
token_label token_run_id token_scenario_id token_dataset_label token_device_id token_logical_client_id
token_physical_host_id token_network_profile_id http_referer http_user_agent session_token content_id
username user_id client_id upstream_response_time connection connection_requests http_range range_header
cache_status request_id http_connection http_accept http_accept_language
""".split()

# Keys an API event adds to the edge record, and its keys that are not text.
API_EVENT_FIELDS = ["@timestamp", "event_source", "event_kind", "cdn_token_id"]
API_EVENT_TYPES = {
    "status": T.LongType(),
    "bytes_sent": T.LongType(),
    "response_time_ms": T.DoubleType(),
    "token_ttl_sec": T.DoubleType(),
    "token_ttl_remaining_sec": T.DoubleType(),
    "token_valid": T.BooleanType(),
    "token_edge_match": T.BooleanType(),
}

# Keys of an origin access-log record.
ORIGIN_LOG_FIELDS = """
timestamp remote_addr client_ip user_id username request_method request_uri query_string status
body_bytes_sent http_referer http_user_agent http_x_forwarded_for request_time
""".split()

# The six relational tables.
TABLES = {
    "users": "id bigint, email string, username string, password_hash string, full_name string, "
    "profile_image string, subscription_plan string, is_active boolean, is_verified boolean, "
    "created_at timestamp, updated_at timestamp, last_login timestamp",
    "sessions": "id bigint, user_id bigint, session_token string, refresh_token string, ip_address string, "
    "user_agent string, device_type string, is_active boolean, expires_at timestamp, "
    "created_at timestamp, last_activity timestamp",
    "watch_history": "id bigint, user_id bigint, content_id string, session_token string, label string, "
    "watch_duration int, total_duration int, progress_percent decimal(5,2), completed boolean, "
    "ip_address string, referer string, created_at timestamp, updated_at timestamp",
    "favorites": "id bigint, user_id bigint, content_id string, created_at timestamp",
    "contents": "content_id string, hls_path string, title string, description string, thumbnail string, "
    "backdrop string, duration string, duration_sec int, year int, rating string, genre array<string>, "
    "category string, content_type string, featured boolean, available_resolutions array<string>, "
    "source_path string, created_at timestamp, updated_at timestamp",
    "audit_logs": "id bigint, user_id bigint, action string, ip_address string, user_agent string, "
    "details string, success boolean, created_at timestamp",
}


def text_struct(fields: list[str], types: dict[str, T.DataType] | None = None) -> T.StructType:
    types = types or {}
    return T.StructType([T.StructField(name, types.get(name, T.StringType())) for name in fields])
