"""Ids, labels, devices, regions and other facts derived from one request."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import names_any, percent_decode
from .values import is_known, known

# Renditions a segment path may name, and the longest graph id.
RENDITIONS = ["1080p", "720p", "480p", "360p", "240p"]
GRAPH_ID_LENGTH = 160

# Marks in a user agent, tested in this order.
DEVICE_MARKS = [
    ("script", ["python", "curl", "wget"]),
    ("tv", ["smart-tv", "tizen", "webos"]),
    ("mobile", ["mobile", "iphone", "android"]),
    ("browser", ["chrome", "safari", "firefox", "edge"]),
]

# Region by edge-id suffix, by last octet of 192.168.0.0/24, by older prefixes.
EDGE_REGIONS = {"-kr": "KR", "-jp": "JP", "-sg": "SG", "-us": "US"}
SUBNET_REGIONS = [(11, 19, "KR"), (21, 29, "JP"), (31, 39, "SG"), (41, 49, "US")]
PREFIX_REGIONS = {"192.168.10.": "KR", "192.168.20.": "JP", "192.168.30.": "SG", "192.168.40.": "US"}

_IPV4 = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"


def _short_sha(col: Column, length: int) -> Column:
    return F.substr(F.sha2(col, 256), F.lit(1), F.lit(length))


def safe_id(text: Column, fallback: str | Column = "unknown") -> Column:
    fallback = F.lit(fallback) if isinstance(fallback, str) else fallback
    value = F.coalesce(known(F.trim(text)), fallback)
    return F.left(F.regexp_replace(value, r"[^\p{L}\p{N}._\-]", "_"), F.lit(GRAPH_ID_LENGTH))


def token_id(token: Column) -> Column:
    return F.when(is_known(token), F.concat(F.lit("cdn_"), _short_sha(token, 24))).otherwise("")


def request_id(log_id: Column, timestamp: Column, connection: Column, ip: Column, path: Column) -> Column:
    seed = F.coalesce(known(log_id), F.concat_ws("|", timestamp, connection, ip, path))
    return F.concat(F.lit("req_"), _short_sha(seed, 24))


def session_id(
    run: Column, app_session: Column, token: Column, account: Column, content: Column, request: Column
) -> Column:
    """Session key: the run, else the token, else session/account/content, else the request."""
    seed = F.concat_ws("|", known(app_session), known(account), known(content))
    key = (
        F.when(is_known(run), safe_id(run))
        .when(token != "", safe_id(token))
        .when(seed != "", _short_sha(seed, 24))
        .otherwise(safe_id(request))
    )
    return F.concat(F.lit("vs_"), key)


def content_type(content: Column, path: Column) -> Column:
    live = F.lower(content).startswith("live_") | F.lower(path).contains("/hls/live_")
    return F.when(live, "live").otherwise("vod")


def device_class(user_agent: Column, low: Column | None = None) -> Column:
    low = F.lower(user_agent) if low is None else low
    out = F.when(~is_known(user_agent), "unknown")
    for name, marks in DEVICE_MARKS:
        out = out.when(names_any(low, marks), name)
    return out.otherwise("other")


def device_id(given: Column, user_agent: Column) -> Column:
    ua = F.trim(user_agent)
    hashed = F.when(is_known(ua), F.concat(F.lit("device_"), _short_sha(ua, 16)))
    return F.coalesce(known(given), hashed, F.lit("device_unknown"))


def resolve_label(label: Column, dataset: Column) -> Column:
    return F.coalesce(known(label), known(dataset), F.lit("normal"))


def region_from_edge(edge: Column) -> Column:
    low = F.lower(edge)
    out = None
    for suffix, region in EDGE_REGIONS.items():
        hit = low.endswith(suffix)
        out = F.when(hit, region) if out is None else out.when(hit, region)
    return out.otherwise("UNKNOWN")


def normalize_ip(raw: Column) -> Column:
    """First address of a forwarded list without the IPv4-in-IPv6 prefix."""
    first = F.trim(F.substring_index(F.coalesce(raw, F.lit("")), ",", 1))
    return F.trim(F.regexp_replace(first, "^::ffff:", ""))


def ipv4_number(ip: Column) -> Column:
    """IPv4 address as a number, NULL for other text or octets over 255."""
    octets = F.split(F.when(ip.rlike(_IPV4), ip), r"\.")
    part = [F.get(octets, i).cast("bigint") for i in range(4)]
    number = ((part[0] * 256 + part[1]) * 256 + part[2]) * 256 + part[3]
    valid = F.greatest(*part) <= 255
    return F.when(valid, number)


def region_from_ip(raw_ip: Column) -> Column:
    ip = normalize_ip(raw_ip)
    base = (192 << 24) + (168 << 16)
    last = ipv4_number(ip) - base
    out = None
    for low, high, region in SUBNET_REGIONS:
        hit = last.between(low, high)
        out = F.when(hit, region) if out is None else out.when(hit, region)
    for prefix, region in PREFIX_REGIONS.items():
        out = out.when(ip.startswith(prefix), region)
    return out.otherwise("UNKNOWN")


def segment_parts(path: Column) -> Column:
    """``struct<content_id, filename, resolution, number, segment_id>`` of an HLS segment path.

    NULL if the path has fewer than two components after ``/hls/``.
    """
    rest = F.substr(F.substring_index(path, "?", 1), F.lit(len("/hls/") + 1))
    parts = F.filter(F.split(rest, "/"), lambda p: p != "")
    content = F.trim(percent_decode(F.get(parts, 0)))
    filename = F.trim(percent_decode(F.element_at(parts, -1)))
    rendition = F.try_element_at(parts, F.lit(-2))
    resolution = F.when((F.size(parts) >= 3) & rendition.isin(RENDITIONS), rendition)
    number = F.regexp_replace(filename, "[^0-9]", "").try_cast("bigint")
    return F.when(
        path.startswith("/hls/") & (F.size(parts) >= 2),
        F.struct(
            content.alias("content_id"),
            filename.alias("filename"),
            resolution.alias("resolution"),
            number.alias("number"),
            F.concat_ws("_", content, resolution, filename).alias("segment_id"),
        ),
    )
