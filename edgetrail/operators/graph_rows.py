"""Graph rows: eligible requests with every id, kind and label the folds read."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity, urls
from ..functions.values import is_known, known, truthy
from .normalize import normalize_requests

c = F.col


def _or_dash(name: str) -> Column:
    return F.coalesce(known(c(name)), F.lit("-"))


def _edge_region() -> Column:
    given = F.when(~c("n_client_region").isin("", "-", "UNKNOWN"), c("n_client_region"))
    return F.coalesce(given, identity.region_from_edge(c("edge_id")))


# Derived column: the columns it reads and its expression.  ``n_`` marks a normalized column.
DERIVED: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "status": (("n_status",), lambda: c("n_status")),
    "request_kind": (
        ("request_path", "n_method"),
        lambda: urls.kind_of_path(c("request_path"), c("n_method")),
    ),
    "request_path": (("n_content_path",), lambda: urls.strip_query(c("n_content_path"))),
    "method": (("n_method",), lambda: c("n_method")),
    "named_content_id": (
        ("request_kind", "request_path", "n_referer"),
        lambda: urls.path_content_id(c("request_kind"), c("request_path"), c("n_referer")),
    ),
    "content_id": (
        ("named_content_id", "n_query_content_id", "n_token_content_id"),
        lambda: urls.request_content_id(c("n_query_content_id"), c("named_content_id"), c("n_token_content_id")),
    ),
    "run_id": (("n_run_id",), lambda: _or_dash("n_run_id")),
    "scenario_id": (("n_scenario_id",), lambda: _or_dash("n_scenario_id")),
    "dataset_label": (("n_dataset_label",), lambda: _or_dash("n_dataset_label")),
    "label": (
        ("n_label", "n_dataset_label"),
        lambda: identity.resolve_label(c("n_label"), c("n_dataset_label")),
    ),
    "logical_client_id": (("n_logical_client_id",), lambda: _or_dash("n_logical_client_id")),
    "physical_host_id": (("n_physical_host_id",), lambda: _or_dash("n_physical_host_id")),
    "network_profile_id": (("n_network_profile_id",), lambda: _or_dash("n_network_profile_id")),
    "token_issued_at": (("n_token_issued_at",), lambda: _or_dash("n_token_issued_at")),
    "token_expires": (("n_token_expires",), lambda: _or_dash("n_token_expires")),
    "token_ttl_sec": (("n_token_ttl_sec",), lambda: c("n_token_ttl_sec")),
    "token_ttl_remaining_sec": (("n_token_ttl_remaining_sec",), lambda: c("n_token_ttl_remaining_sec")),
    "token_valid": (("n_token_valid",), lambda: F.lower("n_token_valid") == "true"),
    "edge_id": (("n_edge_server",), lambda: truthy(c("n_edge_server"), F.lit("edge-unknown"))),
    "edge_region": (("n_client_region", "edge_id"), _edge_region),
    "request_id": (
        ("n_request_log_id", "n_timestamp", "n_connection_id", "n_client_ip", "n_content_path"),
        lambda: identity.request_id(
            c("n_request_log_id"), c("n_timestamp"), c("n_connection_id"), c("n_client_ip"), c("n_content_path")
        ),
    ),
    "token": (("n_session_token",), lambda: c("n_session_token")),
    "cdn_token_id": (
        ("n_cdn_token_id", "n_session_token"),
        lambda: F.when(c("n_cdn_token_id") != "", c("n_cdn_token_id")).otherwise(identity.token_id(c("n_session_token"))),
    ),
    "app_session_id": (("n_playback_session_id",), lambda: c("n_playback_session_id")),
    "account_id": (("n_account_id",), lambda: c("n_account_id")),
    "username": (("n_username",), lambda: c("n_username")),
    "user_id": (("n_user_id",), lambda: c("n_user_id")),
    "client_ip": (("n_client_ip",), lambda: c("n_client_ip")),
    "viewing_session_id": (
        ("run_id", "app_session_id", "cdn_token_id", "account_id", "content_id", "request_id"),
        lambda: identity.session_id(
            c("run_id"), c("app_session_id"), c("cdn_token_id"), c("account_id"), c("content_id"), c("request_id")
        ),
    ),
    "content_type": (
        ("content_id", "request_path"),
        lambda: identity.content_type(c("content_id"), c("request_path")),
    ),
    "device_id": (
        ("n_device_id", "n_user_agent"),
        lambda: identity.device_id(c("n_device_id"), c("n_user_agent")),
    ),
    "low_agent": (("n_user_agent",), lambda: F.lower("n_user_agent")),
    "device_type": (
        ("n_user_agent", "low_agent"),
        lambda: identity.device_class(c("n_user_agent"), c("low_agent")),
    ),
    "user_agent": (("n_user_agent",), lambda: c("n_user_agent")),
    "referer": (("n_referer",), lambda: c("n_referer")),
    "referrer_host": (("n_referer",), lambda: urls.referrer_host(c("n_referer"))),
    "referrer": (("n_referer", "referrer_host"), lambda: urls.referrer(c("n_referer"), c("referrer_host"))),
    "referrer_domain": (("referrer",), lambda: c("referrer.domain")),
    "referrer_category": (("referrer",), lambda: c("referrer.category")),
    "referrer_legitimate": (("referrer",), lambda: c("referrer.is_legitimate")),
    "bytes_sent": (("n_size",), lambda: c("n_size")),
    "response_time_ms": (("n_response_time_ms",), lambda: c("n_response_time_ms")),
    "cache_status": (("n_cache_status",), lambda: c("n_cache_status")),
    "range_header": (("n_http_range",), lambda: c("n_http_range")),
    "keep_alive": (("n_keep_alive",), lambda: c("n_keep_alive")),
    "segment": (
        ("request_kind", "request_path"),
        lambda: F.when(c("request_kind") == "hls_segment", identity.segment_parts(c("request_path"))),
    ),
}

ALL_COLUMNS = [name for name in DERIVED if name not in ("referrer", "referrer_host", "named_content_id", "low_agent")]


@cache
def _level(name: str) -> int:
    """Number of projections below a derived column."""
    reads = [d for d in DERIVED[name][0] if d in DERIVED]
    return 1 + max((_level(d) for d in reads), default=0)


def _closure(names: Iterable[str]) -> set[str]:
    todo, seen = list(names), set()
    while todo:
        name = todo.pop()
        if name not in seen:
            seen.add(name)
            todo.extend(d for d in DERIVED.get(name, ((),))[0])
    return seen


def request_columns(columns: Iterable[str] | None = None) -> list[str]:
    """The normalized columns that graph rows with these columns are derived from."""
    needed = _closure([*(ALL_COLUMNS if columns is None else columns), "status", "request_kind"])
    return sorted(name[2:] for name in needed if name.startswith("n_"))


def graph_rows(logs: DataFrame, columns: Iterable[str] | None = None, raw: str = "raw") -> DataFrame:
    """Requests with status 200-399 and a known kind, with ``fold_ts`` and the input columns.

    ``columns`` limits the derivation, and with it the JSON keys that are parsed.
    """
    wanted = list(columns) if columns is not None else ALL_COLUMNS
    rest = [name for name in logs.columns if name != raw]
    return rows_of_requests(normalize_requests(logs, request_columns(wanted), raw), rest, wanted)


def rows_of_requests(requests: DataFrame, rest: list[str], columns: Iterable[str] | None = None, also: Column | None = None) -> DataFrame:
    """Graph rows from requests that are normalized already; ``rest`` are columns to keep.

    Rows for which ``also``, a condition on ``rest``, holds stay whether they are eligible or not.
    """
    wanted = list(columns) if columns is not None else ALL_COLUMNS
    needed = _closure([*wanted, "status", "request_kind"])
    rows = requests.select(*rest, "fold_ts", *[c(n).alias(f"n_{n}") for n in request_columns(wanted)])
    derived = sorted((n for n in needed if n in DERIVED), key=lambda n: (_level(n), n))
    for level in range(1, max(_level(n) for n in derived) + 1):
        rows = rows.withColumns({n: DERIVED[n][1]() for n in derived if _level(n) == level})
        if level == _level("request_kind"):
            rows = graph_eligible(rows, also)
    return rows.select(*rest, "fold_ts", *wanted)


def graph_eligible(rows: DataFrame, also: Column | None = None) -> DataFrame:
    """Status 200-399 and a known kind, or ``also``."""
    eligible = c("status").between(200, 399) & c("request_kind").isNotNull()
    return rows.where(eligible if also is None else eligible | also)
