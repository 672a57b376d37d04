"""Node tables, one fold each over graph rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .folds import Fold


def _named(*names: str) -> dict[str, str]:
    return {n: n for n in names}


def _if_known(*names: str) -> dict[str, tuple[str, str]]:
    return {n: (n, f"{n} <> '-'") for n in names}


_IDENTITY = ("device_id", "logical_client_id", "physical_host_id", "network_profile_id")
_RUN = ("run_id", "scenario_id", "dataset_label", "label")
_NO_TTL = "coalesce(token_ttl_sec, 0.0D)"

REQUEST = Fold(
    key="request_id",
    first={"first_seen": "fold_ts"},
    last={
        "timestamp": "fold_ts",
        "method": "method",
        "path": "request_path",
        "kind": "request_kind",
        "target_content_id": "if(content_id = '', NULL, content_id)",
        "cdn_token_id": "if(cdn_token_id = '', NULL, cdn_token_id)",
        "app_session_id": "if(app_session_id = '-', NULL, app_session_id)",
        "edge_id": "edge_id",
        "client_ip": "if(client_ip = '-', NULL, client_ip)",
        **_named(
            "referrer_domain", "referer", "status", "bytes_sent", "response_time_ms", "cache_status",
            "range_header", "keep_alive", "user_agent", *_RUN, "token_ttl_sec", "token_ttl_remaining_sec",
        ),
    },
    last_known=_if_known("token_issued_at", "token_expires", *_IDENTITY),
)

CONTENT = Fold(
    key="content_id",
    where="content_id <> ''",
    first={"title": "content_id", "type": "content_type", "first_accessed": "fold_ts"},
    last={"last_accessed": "fold_ts"},
    sums={"request_count": "1L", "total_bytes": "bytes_sent"},
)

VIEWING_SESSION = Fold(
    key="viewing_session_id",
    first={"start_time": "fold_ts"},
    last={"last_time": "fold_ts", "end_time": "fold_ts", **_named(*_RUN)},
    last_known={
        **_if_known("app_session_id", "account_id", "token_issued_at", "token_expires", *_IDENTITY),
        "content_id": ("content_id", "content_id <> ''"),
        "content_type": ("content_type", "content_id <> ''"),
        "token_ttl_sec": ("token_ttl_sec", "token_ttl_sec <> 0"),
    },
    sums={
        "request_count": "1L",
        "total_manifest_requests": "cast(request_kind = 'hls_manifest' as bigint)",
        "total_segment_requests": "cast(request_kind = 'hls_segment' as bigint)",
        "total_playback_start_requests": "cast(request_kind = 'playback_start' as bigint)",
        "total_browse_requests": "cast(request_kind = 'browse_content' as bigint)",
        "total_bytes": "bytes_sent",
    },
    maxes={
        "is_live": "content_type = 'live'",
        "has_browse": "request_kind = 'browse_content'",
        "has_playback_start": "request_kind = 'playback_start'",
    },
    first_order_of={"start": "request_kind = 'playback_start'", "browse": "request_kind = 'browse_content'"},
    finish={
        "token_ttl_sec": _NO_TTL,
        "playback_without_browse": "has_playback_start AND (NOT has_browse OR _order_start < _order_browse)",
    },
)

ACCOUNT = Fold(
    key="account_id",
    where="account_id <> '-' AND account_id <> ''",
    first={"created_at": "fold_ts", "_username": "username", "_user_id": "user_id"},
    last={"last_seen": "fold_ts"},
    last_known=_if_known("username", "user_id"),
    finish={
        "tier": "'basic'",
        "status": "'normal'",
        "username": "coalesce(username, _username)",
        "user_id": "coalesce(user_id, _user_id)",
    },
)

CDN_TOKEN = Fold(
    key="cdn_token_id",
    where="cdn_token_id <> ''",
    first={"first_seen": "fold_ts", "token_prefix": "left(token, 12)"},
    last={"last_seen": "fold_ts", **_named(*_RUN), "valid": "token_valid"},
    last_known={
        **_if_known("app_session_id", "token_issued_at", "token_expires", *_IDENTITY),
        "content_id": ("content_id", "content_id <> ''"),
        "token_ttl_sec": ("token_ttl_sec", "token_ttl_sec <> 0"),
    },
    finish={"token_ttl_sec": _NO_TTL},
)

CLIENT_IP = Fold(
    key="ip_address",
    source="client_ip",
    where="client_ip <> '-' AND client_ip <> ''",
    first={"first_seen": "fold_ts"},
    last={"last_seen": "fold_ts"},
)

DEVICE = Fold(
    key="device_id",
    first={"first_seen": "fold_ts", "user_agent": "user_agent", "device_type": "device_type"},
    last={"last_seen": "fold_ts"},
)

EDGE = Fold(
    key="edge_id",
    first={"first_seen": "fold_ts"},
    last={"last_seen": "fold_ts", "region": "edge_region"},
)

REFERRER = Fold(
    key="domain",
    source="referrer_domain",
    first={"first_seen": "fold_ts"},
    last={"last_seen": "fold_ts", "category": "referrer_category", "is_legitimate": "referrer_legitimate"},
)

SEGMENT = Fold(
    key="segment_id",
    source="segment.segment_id",
    where="segment IS NOT NULL",
    first={
        "filename": "segment.filename",
        "number": "segment.number",
        "resolution": "segment.resolution",
        "path": "request_path",
        "first_accessed": "fold_ts",
    },
    last={"last_accessed": "fold_ts"},
    maxes={"size_bytes": "bytes_sent"},
)

NODE_FOLDS: dict[str, Fold] = {
    "Request": REQUEST,
    "Content": CONTENT,
    "ViewingSession": VIEWING_SESSION,
    "Account": ACCOUNT,
    "CdnToken": CDN_TOKEN,
    "ClientIP": CLIENT_IP,
    "Device": DEVICE,
    "Edge": EDGE,
    "Referrer": REFERRER,
    "Segment": SEGMENT,
}

# Graph-row columns each fold reads, so that a single table needs only these derived.
_TOKEN = ("token_issued_at", "token_expires", "token_ttl_sec")
NODE_INPUTS: dict[str, tuple[str, ...]] = {
    "Request": (
        "request_id", "method", "request_path", "request_kind", "content_id", "cdn_token_id", "app_session_id",
        "edge_id", "client_ip", "referrer_domain", "referer", "status", "bytes_sent", "response_time_ms",
        "cache_status", "range_header", "keep_alive", "user_agent", *_RUN, *_TOKEN, "token_ttl_remaining_sec",
        *_IDENTITY,
    ),
    "Content": ("content_id", "content_type", "bytes_sent"),
    "ViewingSession": (
        "viewing_session_id", *_RUN, "app_session_id", "account_id", "content_id", "content_type", *_TOKEN,
        *_IDENTITY, "request_kind", "bytes_sent",
    ),
    "Account": ("account_id", "username", "user_id"),
    "CdnToken": (
        "cdn_token_id", "token", *_RUN, "token_valid", "app_session_id", *_TOKEN, *_IDENTITY, "content_id",
    ),
    "ClientIP": ("client_ip",),
    "Device": ("device_id", "user_agent", "device_type"),
    "Edge": ("edge_id", "edge_region"),
    "Referrer": ("referrer_domain", "referrer_category", "referrer_legitimate"),
    "Segment": ("segment", "request_path", "bytes_sent"),
}


def nodes(rows: DataFrame, label: str) -> DataFrame:
    """Node table of one label from graph rows."""
    out = NODE_FOLDS[label].apply(rows)
    return out.drop("_username", "_user_id")
