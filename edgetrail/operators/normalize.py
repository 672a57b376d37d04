"""Normalization of a raw log record into one request row.

Each normalized column is an expression over log keys and query parameters.  Only the keys
that the requested columns read are parsed out of the JSON text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity, urls
from ..functions.values import is_known, known, present, to_double, to_long, truthy
from ..sources.logs import CORRUPT, input_name, parse_records

# An address that hides the client, and the text that replaces it.
HIDDEN_ADDRESS = "172.18.0.1"
HIDDEN_CLIENT = "device_unknown"
EPOCH = "1970-01-01T00:00:00Z"


class Record:
    """Gives expressions their inputs and remembers which inputs were asked for."""

    def __init__(self) -> None:
        self.keys: dict[str, None] = {}
        self.uses_query = False
        self.shared: dict[str, tuple[int, Column]] = {}

    def log(self, key: str) -> Column:
        self.keys[key] = None
        return F.col(input_name(key))

    def param(self, key: str) -> Column:
        """Decoded query parameter, the last one if repeated, NULL if absent."""
        self.uses_query = True
        value = F.get("_param_values", F.array_position("_param_names", F.lit(key)) - 1)
        return self.share(f"param_{key}", value, level=0)

    def params(self) -> Column:
        self.uses_query = True
        names = F.array_distinct(F.col("_param_names"))
        values = F.transform(
            names, lambda n: F.get("_param_values", F.array_position("_param_names", n) - 1)
        )
        none = F.create_map().cast("map<string,string>")
        return F.coalesce(F.map_from_arrays(names, values), none)

    def share(self, name: str, expr: Column, level: int = 1) -> Column:
        """A value that several expressions read, computed once in an earlier projection."""
        self.shared[name] = (level, expr)
        return F.col(f"_shared_{name}")


def _dash() -> Column:
    return F.lit("-")


def _client_ip(r: Record) -> Column:
    """First address that is not ``-``; an empty one counts, the forwarded list comes last."""
    observed = [r.log(key) for key in ("client_ip", "client_real_ip", "real_ip", "remote_addr")]
    forwarded = r.log("x_forwarded_for")
    first = F.trim(F.substring_index(forwarded, ",", 1))
    chain = [F.when(a != "-", a) for a in observed] + [F.when(forwarded != "-", first), _dash()]
    address = r.share("address", F.coalesce(*chain))
    return F.when(address == HIDDEN_ADDRESS, HIDDEN_CLIENT).otherwise(address)


def _user_id(r: Record) -> Column:
    return r.share("user_id", present(r.param("user_id"), r.log("token_user_id"), r.log("user_id"), _dash()))


def _username(r: Record) -> Column:
    return r.share("username", present(r.param("user"), r.log("username"), _dash()))


def _account_id(r: Record) -> Column:
    user, name = _user_id(r), _username(r)
    return (
        F.when(is_known(user), F.concat(F.lit("user_"), user))
        .when(is_known(name), F.concat(F.lit("guest_"), name))
        .otherwise("-")
    )


def _app_session(r: Record) -> Column:
    chosen = truthy(r.param("sid"), r.log("token_session_id"), r.param("session_id"), r.log("session_id"))
    return F.coalesce(chosen, _dash())


def _dataset_label(r: Record) -> Column:
    return present(r.param("dataset_label"), r.log("token_dataset_label"), _dash())


def _label(r: Record) -> Column:
    return present(r.param("label"), r.log("token_label"), _dataset_label(r))


def _path(r: Record) -> Column:
    return r.share("path", truthy(r.log("request_uri"), r.log("url.original"), r.log("uri"), _dash()))


def _resource(r: Record) -> Column:
    low = r.share("low_path", F.lower(_path(r)), level=2)
    return r.share("resource", urls.resource_type(_path(r), low), level=3)


def _text(key: str, default: str = "-") -> Callable[[Record], Column]:
    return lambda r: F.coalesce(r.log(key), F.lit(default))


def _first_of(params: list[str], keys: list[str]) -> Callable[[Record], Column]:
    return lambda r: truthy(*[r.param(p) for p in params], *[r.log(k) for k in keys], _dash())


def _run_field(name: str) -> Callable[[Record], Column]:
    return lambda r: present(r.param(name), r.log(f"token_{name}"), _dash())


def _timestamp(r: Record) -> Column:
    value = r.share("timestamp", truthy(r.log("@timestamp"), r.log("timestamp"), r.log("event.created")))
    shown = F.trim(value)
    iso = (F.length(shown) >= 19) & (F.substr(shown, F.lit(5), F.lit(1)) == "-") & (
        F.substr(shown, F.lit(11), F.lit(1)) == "T"
    )
    return F.when(iso, value).otherwise(EPOCH)


def _keep_alive(r: Record) -> Column:
    return F.coalesce(F.lower(r.log("http_connection")) == "keep-alive", F.lit(False))


NORMALIZED: dict[str, Callable[[Record], Column]] = {
    "timestamp": _timestamp,
    "account_id": _account_id,
    "user_id": _user_id,
    "username": _username,
    "client_ip": _client_ip,
    "client_region": _text("client_region", "UNKNOWN"),
    "edge_server": _text("edge_server"),
    "domain": lambda r: F.coalesce(
        urls.url_domain(r.log("http_referer")), urls.url_domain(r.log("http_host"))
    ),
    "session_token": lambda r: present(r.param("token"), r.log("session_token"), _dash()),
    "cdn_token_id": _text("cdn_token_id", ""),
    "playback_session_id": _app_session,
    "run_id": _run_field("run_id"),
    "scenario_id": _run_field("scenario_id"),
    "label": _label,
    "dataset_label": _dataset_label,
    "device_id": _first_of(["device_id", "device"], ["token_device_id", "device_id"]),
    "logical_client_id": _first_of(
        ["logical_client_id", "client_id"], ["token_logical_client_id", "logical_client_id"]
    ),
    "physical_host_id": _first_of(["physical_host_id"], ["token_physical_host_id", "physical_host_id"]),
    "network_profile_id": _first_of(
        ["network_profile_id"], ["token_network_profile_id", "network_profile_id"]
    ),
    "token_content_id": _text("token_content_id"),
    "token_issued_at": _text("token_issued_at"),
    "token_expires": _text("token_expires"),
    "token_ttl_sec": lambda r: to_double(r.log("token_ttl_sec")),
    "token_ttl_remaining_sec": lambda r: to_double(r.log("token_ttl_remaining_sec")),
    "token_valid": _text("token_valid"),
    "token_edge_match": _text("token_edge_match"),
    "referer": _text("http_referer"),
    "query_params": lambda r: r.params(),
    "query_content_id": lambda r: F.coalesce(r.param("content_id"), F.lit("")),
    "content_path": _path,
    "content_title": lambda r: urls.path_title(_path(r)),
    "content_filename": lambda r: urls.path_filename(_path(r)),
    "method": lambda r: truthy(r.log("request_method"), r.log("http.request.method"), F.lit("GET")),
    "status": lambda r: to_long(F.coalesce(r.log("status"), r.log("http.response.status_code"))),
    "size": lambda r: to_long(F.coalesce(r.log("bytes_sent"), r.log("http.response.body.bytes"))),
    "response_time_ms": lambda r: to_double(
        F.coalesce(r.log("response_time_ms"), r.log("upstream_response_time"))
    ),
    "cache_status": _text("cache_status"),
    "request_log_id": _text("request_id"),
    "user_agent": _text("http_user_agent"),
    "resource_type": lambda r: _resource(r)["type"],
    "resource_category": lambda r: _resource(r)["category"],
    "connection_id": _text("connection"),
    "connection_requests": lambda r: to_long(r.log("connection_requests")),
    "http_range": _text("http_range"),
    "keep_alive": _keep_alive,
    "http_accept": _text("http_accept"),
    "http_accept_language": _text("http_accept_language"),
    # Beyond the request row itself: values the reports and checks read.
    "event_ts": lambda r: F.try_to_timestamp(r.log("timestamp")),
    "ingest_ts": lambda r: F.try_to_timestamp(r.log("@timestamp")),
    "event_kind": _text("event_kind"),
    "service": lambda r: truthy(r.log("service"), r.log("edge_service"), _dash()),
    "remote_addr": _text("remote_addr"),
    "http_x_session_token": _text("http_x_session_token", ""),
    "log_session_token": _text("session_token"),
    "token_client_field": _text("token_logical_client_id"),
}

# The request row: everything above up to the extra values.
REQUEST_COLUMNS = [
    c
    for c in list(NORMALIZED)[: list(NORMALIZED).index("event_ts")]
    if c != "query_content_id"
]


def _read(logs: DataFrame, columns: Iterable[str], raw: str) -> tuple[DataFrame, dict[str, Column], Column]:
    record = Record()
    exprs = {name: NORMALIZED[name](record) for name in columns}
    fold_ts = F.try_to_timestamp(F.trim(_timestamp(record)))
    keys = dict(record.keys)
    if record.uses_query:
        keys["query_string"] = None
    step = parse_records(logs, list(keys), raw)
    if record.uses_query:
        pieces = F.split(known(F.col(input_name("query_string"))), "&")
        pairs = F.reverse(F.filter(pieces, lambda p: p != ""))
        step = step.withColumn("_pairs", pairs)
        name = F.transform("_pairs", lambda p: urls.form_decode(F.substring_index(p, "=", 1)))
        value = F.transform(
            "_pairs",
            lambda p: urls.form_decode(F.regexp_replace(p, "^[^=]*=?", "")),
        )
        step = step.withColumns({"_param_names": name, "_param_values": value})
    for level in (0, 1, 2, 3):
        step = step.withColumns(
            {f"_shared_{n}": e for n, (at, e) in record.shared.items() if at == level}
        )
    return step, exprs, fold_ts


def normalize_requests(logs: DataFrame, columns: Iterable[str] | None = None, raw: str = "raw") -> DataFrame:
    """One request row per log record, with the other input columns and ``fold_ts``.

    ``columns`` limits the work to the named columns of ``NORMALIZED``.  Malformed records and
    records whose timestamp looks like a date but is none go to ``quarantine`` instead.
    """
    columns = list(columns) if columns is not None else REQUEST_COLUMNS
    rest = [c for c in logs.columns if c != raw]
    step, exprs, fold_ts = _read(logs, columns, raw)
    step = step.where(F.col(CORRUPT).isNull())
    rows = step.select(*rest, fold_ts.alias("fold_ts"), *[e.alias(n) for n, e in exprs.items()])
    return rows.where(F.col("fold_ts").isNotNull())


def classify_records(logs: DataFrame, columns: Iterable[str] | None = None, raw: str = "raw") -> DataFrame:
    """Every record with its normalized columns, its text and ``reason``: NULL, or why it is left out.

    One parse serves both what ``normalize_requests`` returns (no reason) and ``quarantine`` (the others).
    """
    columns = list(columns) if columns is not None else REQUEST_COLUMNS
    rest = [c for c in logs.columns if c != raw]
    step, exprs, fold_ts = _read(logs.withColumn("_text", F.col(raw)), columns, raw)
    reason = F.when(F.col(CORRUPT).isNotNull(), "malformed").when(fold_ts.isNull(), "bad_timestamp")
    return step.select(
        *rest, F.col("_text").alias(raw), reason.alias("reason"), fold_ts.alias("fold_ts"), *[e.alias(n) for n, e in exprs.items()]
    )


def quarantine(logs: DataFrame, raw: str = "raw") -> DataFrame:
    """The records ``normalize_requests`` leaves out, with the reason."""
    return classify_records(logs, [], raw).where("reason IS NOT NULL").select(raw, "reason")
