"""SQL building blocks of the check queries (DuckDB)."""

from __future__ import annotations

from . import inputs


def param(name: str) -> str:
    """Query parameter of the column qs, NULL if absent."""
    return (
        f"CASE WHEN contains('&' || qs, '&{name}=') "
        f"THEN url_decode(replace(regexp_extract('&' || qs, '&{name}=([^&]*)', 1), '+', '%20')) END"
    )


def truthy(*exprs: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({e}, '')" for e in exprs) + ")"


def key(name: str) -> str:
    """A key of the record at top level, else of the nested record."""
    path = '$."' + name + '"'
    return f"coalesce(json_extract_string(raw, '{path}'), json_extract_string(json_extract(raw, '$.json'), '{path}'))"


_KEYS = """timestamp @timestamp client_ip client_real_ip real_ip remote_addr x_forwarded_for client_region
edge_server query_string session_token token_session_id session_id token_user_id user_id username token_run_id
token_scenario_id token_dataset_label token_label token_device_id device_id token_logical_client_id
logical_client_id token_physical_host_id physical_host_id token_network_profile_id network_profile_id
request_uri uri http_referer http_host connection connection_requests http_range http_connection http_accept
http_accept_language status bytes_sent response_time_ms request_method cdn_token_id token_content_id
token_issued_at token_expires token_ttl_sec token_ttl_remaining_sec token_valid token_edge_match cache_status
request_id http_user_agent event_kind service http_x_session_token""".split()


def _col(name: str) -> str:
    return "j_" + name.replace("@", "at_")


def _j(name: str, default: str | None = None) -> str:
    return f"coalesce({_col(name)}, '{default}')" if default is not None else _col(name)


def _number(col: str, kind: str) -> str:
    shape = "^[+-]?[0-9]+$" if kind == "BIGINT" else "^[+-]?[0-9]*[.]?[0-9]+$"
    return f"CASE WHEN regexp_full_match(coalesce({col}, ''), '{shape}') THEN TRY_CAST({col} AS {kind}) ELSE 0 END"


DOMAIN = """CASE WHEN {u} IS NULL OR {u} IN ('', '-') THEN NULL ELSE nullif(regexp_extract(
  CASE WHEN starts_with({u}, 'http') THEN {u} ELSE 'http://' || {u} END, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '') END"""

KIND = """CASE WHEN starts_with(request_path, '/hls/') THEN CASE WHEN ends_with(request_path, '.m3u8') THEN 'hls_manifest'
    WHEN ends_with(request_path, '.ts') THEN 'hls_segment' END
  WHEN method = 'POST' AND request_path = '/api/playback/start' THEN 'playback_start'
  WHEN method = 'GET' AND starts_with(request_path, '/api/browse/content/') THEN 'browse_content' END"""

DEVICE = """CASE WHEN user_agent IN ('', '-') THEN 'unknown'
  WHEN regexp_matches(lower(user_agent), 'python|curl|wget') THEN 'script'
  WHEN regexp_matches(lower(user_agent), 'smart-tv|tizen|webos') THEN 'tv'
  WHEN regexp_matches(lower(user_agent), 'mobile|iphone|android') THEN 'mobile'
  WHEN regexp_matches(lower(user_agent), 'chrome|safari|firefox|edge') THEN 'browser' ELSE 'other' END"""


def resource(url: str) -> tuple[str, str]:
    rules = [
        (f"{url} IS NULL OR {url} IN ('', '-')", "other", "other"),
        (f"regexp_matches(lower({url}), '[.](mp4|m3u8|ts|webm|mkv)')", "video", "video"),
        (f"contains(lower({url}), '.html') OR ends_with({url}, '/') OR contains(lower({url}), 'index')", "html", "web_resource"),
        (f"contains(lower({url}), '.css')", "css", "web_resource"),
        (f"contains(lower({url}), '.js') AND NOT contains(lower({url}), '.json')", "js", "web_resource"),
        (f"contains(lower({url}), '/api/') OR contains(lower({url}), '.json')", "api", "api"),
        (f"regexp_matches(lower({url}), '[.](jpg|jpeg|png|gif|webp|svg)')", "image", "static"),
    ]
    type_ = "CASE " + " ".join(f"WHEN {c} THEN '{t}'" for c, t, _ in rules) + " ELSE 'other' END"
    category = "CASE " + " ".join(f"WHEN {c} THEN '{g}'" for c, _, g in rules) + " ELSE 'other' END"
    return type_, category


def norm_ctes(source: str = "access_log") -> str:
    """CTEs down to ``norm``: one normalized row per record of a derived log."""
    keys = ", ".join(f"{key(k)} AS {_col(k)}" for k in _KEYS)
    ip = "'-'"
    for name in reversed(["client_ip", "client_real_ip", "real_ip", "remote_addr"]):
        ip = f"CASE WHEN {_j(name, '-')} <> '-' THEN {_j(name, '-')} ELSE {ip} END"
    ip = ip.replace("ELSE '-' END", f"ELSE CASE WHEN {_j('x_forwarded_for', '-')} <> '-' THEN trim(split_part({_j('x_forwarded_for')}, ',', 1)) ELSE '-' END END")
    user = f"coalesce({param('user_id')}, {_j('token_user_id')}, {_j('user_id')}, '-')"
    name = f"coalesce({param('user')}, {_j('username')}, '-')"
    path = f"coalesce(nullif({_j('request_uri')}, ''), nullif({_j('uri')}, ''), '-')"
    dataset = f"coalesce({param('dataset_label')}, {_j('token_dataset_label')}, '-')"
    rtype, rcat = resource("content_path")
    return f"""
logs AS ({inputs.SQL[source]}),
parsed AS (SELECT arrival, {keys} FROM logs),
with_qs AS (SELECT *, coalesce(nullif(j_query_string, '-'), '') AS qs FROM parsed),
n1 AS (SELECT arrival,
  coalesce(nullif(j_at_timestamp, ''), j_timestamp) AS timestamp,
  CAST(replace(replace(coalesce(nullif(j_at_timestamp, ''), j_timestamp), 'T', ' '), 'Z', '') AS TIMESTAMP) AS fold_ts,
  CAST(replace(replace(j_timestamp, 'T', ' '), 'Z', '') AS TIMESTAMP) AS event_ts,
  CAST(replace(replace(j_at_timestamp, 'T', ' '), 'Z', '') AS TIMESTAMP) AS ingest_ts,
  {user} AS user_id, {name} AS username,
  CASE WHEN ({ip}) = '172.18.0.1' THEN 'device_unknown' ELSE ({ip}) END AS client_ip,
  {_j('client_region', 'UNKNOWN')} AS client_region, {_j('edge_server', '-')} AS edge_server,
  coalesce({DOMAIN.format(u='j_http_referer')}, {DOMAIN.format(u='j_http_host')}) AS domain,
  coalesce({param('token')}, {_j('session_token')}, '-') AS session_token,
  {_j('cdn_token_id', '')} AS cdn_token_given,
  coalesce(nullif({param('sid')}, ''), nullif({_j('token_session_id')}, ''), nullif({param('session_id')}, ''), nullif({_j('session_id')}, ''), '-') AS playback_session_id,
  coalesce({param('run_id')}, {_j('token_run_id')}, '-') AS run_id,
  coalesce({param('scenario_id')}, {_j('token_scenario_id')}, '-') AS scenario_id,
  {dataset} AS dataset_label,
  coalesce({param('label')}, {_j('token_label')}, {dataset}) AS label,
  coalesce(nullif({param('device_id')}, ''), nullif({param('device')}, ''), nullif({_j('token_device_id')}, ''), nullif({_j('device_id')}, ''), '-') AS device_given,
  coalesce(nullif({param('logical_client_id')}, ''), nullif({param('client_id')}, ''), nullif({_j('token_logical_client_id')}, ''), nullif({_j('logical_client_id')}, ''), '-') AS logical_client_id,
  coalesce(nullif({param('physical_host_id')}, ''), nullif({_j('token_physical_host_id')}, ''), nullif({_j('physical_host_id')}, ''), '-') AS physical_host_id,
  coalesce(nullif({param('network_profile_id')}, ''), nullif({_j('token_network_profile_id')}, ''), nullif({_j('network_profile_id')}, ''), '-') AS network_profile_id,
  {_j('token_content_id', '-')} AS token_content_id, {_j('token_issued_at', '-')} AS token_issued_at,
  {_j('token_expires', '-')} AS token_expires,
  CAST({_number(_j('token_ttl_sec'), 'DOUBLE')} AS DOUBLE) AS token_ttl_sec,
  CAST({_number(_j('token_ttl_remaining_sec'), 'DOUBLE')} AS DOUBLE) AS token_ttl_remaining_sec,
  {_j('token_valid', '-')} AS token_valid_text, {_j('token_edge_match', '-')} AS token_edge_match,
  {_j('http_referer', '-')} AS referer, coalesce({param('content_id')}, '') AS query_content_id,
  {path} AS content_path, coalesce(nullif(j_request_method, ''), 'GET') AS method,
  CAST({_number(_j('status'), 'BIGINT')} AS BIGINT) AS status, CAST({_number(_j('bytes_sent'), 'BIGINT')} AS BIGINT) AS size,
  CAST({_number(_j('response_time_ms'), 'DOUBLE')} AS DOUBLE) AS response_time_ms,
  {_j('cache_status', '-')} AS cache_status, {_j('request_id', '-')} AS request_log_id,
  {_j('http_user_agent', '-')} AS user_agent, {_j('connection', '-')} AS connection_id,
  CAST({_number(_j('connection_requests'), 'BIGINT')} AS BIGINT) AS connection_requests,
  {_j('http_range', '-')} AS http_range, coalesce(lower(j_http_connection) = 'keep-alive', false) AS keep_alive,
  {_j('http_accept', '-')} AS http_accept, {_j('http_accept_language', '-')} AS http_accept_language,
  {_j('event_kind', '-')} AS event_kind, coalesce(nullif(j_service, ''), '-') AS service,
  {_j('remote_addr', '-')} AS remote_addr, {_j('http_x_session_token', '')} AS http_x_session_token,
  {_j('session_token', '-')} AS log_session_token
  FROM with_qs),
norm AS (SELECT *,
  CASE WHEN user_id NOT IN ('', '-') THEN 'user_' || user_id WHEN username NOT IN ('', '-') THEN 'guest_' || username ELSE '-' END AS account_id,
  CASE WHEN content_path = '-' THEN '' ELSE split_part(content_path, '?', 1) END AS request_path,
  CASE WHEN len(string_split(trim(content_path, '/'), '/')) >= 2 THEN split_part(trim(content_path, '/'), '/', 2) ELSE 'unknown' END AS content_title,
  nullif(regexp_extract(split_part(content_path, '?', 1), '([^/]*)$', 1), '') AS content_filename,
  {rtype} AS resource_type, {rcat} AS resource_category
  FROM n1)"""


def rows_ctes(source: str = "access_log") -> str:
    """CTEs down to ``rows``: the graph rows."""
    sha = "substr(sha256({}), 1, {})"
    known = "nullif(nullif({}, ''), '-')"
    return norm_ctes(source) + f""",
g0 AS (SELECT * FROM (SELECT *, {KIND} AS request_kind FROM norm) k WHERE status BETWEEN 200 AND 399 AND request_kind IS NOT NULL),
g1 AS (SELECT arrival, fold_ts, status, request_kind, request_path, method,
  CASE WHEN trim(query_content_id) <> '' THEN trim(query_content_id)
    WHEN request_kind = 'browse_content' AND split_part(substr(request_path, 21), '/', 1) <> '' THEN split_part(substr(request_path, 21), '/', 1)
    WHEN request_kind = 'playback_start' AND regexp_extract(referer, '^https?://[^/]*/watch/([^/?#]+)', 1) <> '' THEN regexp_extract(referer, '^https?://[^/]*/watch/([^/?#]+)', 1)
    WHEN starts_with(request_kind, 'hls') AND split_part(request_path, '/', 3) <> '' THEN split_part(request_path, '/', 3)
    WHEN token_content_id NOT IN ('', '-') THEN token_content_id ELSE '' END AS content_id,
  coalesce({known.format('run_id')}, '-') AS run_id, coalesce({known.format('scenario_id')}, '-') AS scenario_id,
  coalesce({known.format('dataset_label')}, '-') AS dataset_label,
  coalesce({known.format('label')}, {known.format('dataset_label')}, 'normal') AS label,
  coalesce({known.format('logical_client_id')}, '-') AS logical_client_id,
  coalesce({known.format('physical_host_id')}, '-') AS physical_host_id,
  coalesce({known.format('network_profile_id')}, '-') AS network_profile_id,
  coalesce({known.format('token_issued_at')}, '-') AS token_issued_at, coalesce({known.format('token_expires')}, '-') AS token_expires,
  token_ttl_sec, token_ttl_remaining_sec, lower(token_valid_text) = 'true' AS token_valid,
  coalesce(nullif(edge_server, ''), 'edge-unknown') AS edge_id, client_region,
  'req_' || {sha.format("coalesce(" + known.format('request_log_id') + ", timestamp || '|' || connection_id || '|' || client_ip || '|' || content_path)", 24)} AS request_id,
  session_token AS token,
  CASE WHEN cdn_token_given <> '' THEN cdn_token_given WHEN session_token NOT IN ('', '-') THEN 'cdn_' || {sha.format('session_token', 24)} ELSE '' END AS cdn_token_id,
  playback_session_id AS app_session_id, account_id, username, user_id, client_ip,
  coalesce({known.format('device_given')}, CASE WHEN trim(user_agent) NOT IN ('', '-') THEN 'device_' || {sha.format('trim(user_agent)', 16)} END, 'device_unknown') AS device_id,
  {DEVICE} AS device_type, user_agent, referer,
  CASE WHEN referer IN ('', '-') THEN 'empty' WHEN starts_with(lower(referer), 'chrome-extension://') THEN 'browser_extension'
    ELSE coalesce(lower({DOMAIN.format(u='referer')}), 'malformed') END AS referrer_domain,
  size AS bytes_sent, response_time_ms, cache_status, http_range AS range_header, keep_alive
  FROM g0),
grows AS (SELECT *,
  'vs_' || CASE WHEN run_id <> '-' THEN left(regexp_replace(run_id, '[^A-Za-z0-9._-]', '_', 'g'), 160)
    WHEN cdn_token_id <> '' THEN left(cdn_token_id, 160)
    WHEN concat_ws('|', {known.format('app_session_id')}, {known.format('account_id')}, {known.format('content_id')}) <> ''
      THEN {sha.format("concat_ws('|', " + ", ".join(known.format(c) for c in ('app_session_id', 'account_id', 'content_id')) + ")", 24)}
    ELSE request_id END AS viewing_session_id,
  CASE WHEN starts_with(lower(content_id), 'live_') OR contains(lower(request_path), '/hls/live_') THEN 'live' ELSE 'vod' END AS content_type,
  CASE WHEN client_region NOT IN ('', '-', 'UNKNOWN') THEN client_region
    WHEN ends_with(lower(edge_id), '-kr') THEN 'KR' WHEN ends_with(lower(edge_id), '-jp') THEN 'JP'
    WHEN ends_with(lower(edge_id), '-sg') THEN 'SG' WHEN ends_with(lower(edge_id), '-us') THEN 'US' ELSE 'UNKNOWN' END AS edge_region,
  CASE referrer_domain WHEN 'empty' THEN 'empty' WHEN 'browser_extension' THEN 'extension' WHEN 'malformed' THEN 'malformed'
    ELSE CASE WHEN regexp_matches(split_part(referrer_domain, ':', 1), '^(192[.]168[.]|10[.]|172[.])|myott|^(localhost|127.0.0.1|ott.local)$') THEN 'legitimate' ELSE 'foreign' END END AS referrer_category,
  CASE WHEN request_kind = 'hls_segment' AND split_part(request_path, '/', 4) <> '' THEN split_part(request_path, '/', 3) END AS seg_content,
  CASE WHEN request_kind = 'hls_segment' AND split_part(request_path, '/', 4) <> '' THEN regexp_extract(request_path, '([^/]*)$', 1) END AS seg_file,
  CASE WHEN request_kind = 'hls_segment' AND split_part(request_path, '/', 4) IN ('1080p', '720p', '480p', '360p', '240p') AND split_part(request_path, '/', 5) <> '' THEN split_part(request_path, '/', 4) END AS seg_resolution
  FROM g1),
segs AS (SELECT *, concat_ws('_', seg_content, seg_resolution, seg_file) AS segment_id FROM grows WHERE seg_file IS NOT NULL)"""


def over_norm(select: str, source: str = "access_log") -> str:
    return f"WITH {norm_ctes(source)} {select}"


def over_rows(select: str, source: str = "access_log") -> str:
    return f"WITH {rows_ctes(source)} {select}"


def over(select: str, *names: str) -> str:
    """A select over derived inputs by their names."""
    return "WITH " + ", ".join(f"{n} AS ({inputs.SQL[n]})" for n in names) + " " + select


# First and last value in fold order, NULL values included.
def first(expr: str) -> str:
    return f"first({expr} ORDER BY fold_ts, arrival)"


def last(expr: str, condition: str | None = None) -> str:
    return f"last({expr} ORDER BY fold_ts, arrival)" + (f" FILTER (WHERE {condition})" if condition else "")


NODES_AND_EDGES = """
pairs AS (
  SELECT 'ViewingSession' AS src_type, viewing_session_id AS src, 'MAKES_REQUEST' AS type, 'Request' AS dst_type, request_id AS dst FROM grows
  UNION SELECT 'Account', account_id, 'HAS_VIEWING_SESSION', 'ViewingSession', viewing_session_id FROM grows WHERE account_id <> '-'
  UNION SELECT 'ViewingSession', viewing_session_id, 'USES_CDN_TOKEN', 'CdnToken', cdn_token_id FROM grows WHERE cdn_token_id <> ''
  UNION SELECT 'ViewingSession', viewing_session_id, 'TARGETS_CONTENT', 'Content', content_id FROM grows WHERE content_id <> ''
  UNION SELECT 'Request', request_id, 'TARGETS_CONTENT', 'Content', content_id FROM grows WHERE content_id <> ''
  UNION SELECT 'ViewingSession', viewing_session_id, 'FROM_IP', 'ClientIP', client_ip FROM grows WHERE client_ip NOT IN ('', '-')
  UNION SELECT 'ViewingSession', viewing_session_id, 'ON_DEVICE', 'Device', device_id FROM grows
  UNION SELECT 'ViewingSession', viewing_session_id, 'SERVED_BY', 'Edge', edge_id FROM grows
  UNION SELECT 'ViewingSession', viewing_session_id, 'REFERRED_BY', 'Referrer', referrer_domain FROM grows
  UNION SELECT 'Request', request_id, 'FOR_SEGMENT', 'Segment', segment_id FROM segs
  UNION SELECT 'Segment', s.segment_id, 'BELONGS_TO', 'Content', s.seg_content FROM segs s
    JOIN (SELECT content_id, min((fold_ts, arrival)) AS at FROM grows WHERE content_id <> '' GROUP BY ALL) c
      ON c.content_id = s.seg_content AND (s.fold_ts, s.arrival) >= c.at)"""
