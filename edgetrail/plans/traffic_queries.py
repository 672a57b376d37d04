"""Traffic, block list, pipeline and scenario reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity
from ..operators import blocklist, edge_choice, reports
from ..operators.graph_rows import graph_rows
from ..operators.normalize import normalize_requests
from ..sources.logs import index_page, parse_ship_timestamp
from . import inputs
from .oracle import norm_ctes, over_norm, over_rows
from .registry import query


def _requests(spark, sf_dir, *columns, source="shipped_log"):
    return normalize_requests(inputs.load(spark, sf_dir, source), columns)


def _newest(spark, sf_dir):
    """Newest record time of the log: its records carry the event times cut to whole seconds."""
    return inputs.given(spark, sf_dir, "events").agg(F.date_trunc("second", F.max("ts"))).first()[0]


_LAST_HOUR = "event_ts >= (SELECT max(event_ts) FROM norm) - INTERVAL 48 HOUR"


@query(
    "traffic_totals",
    over_norm(f"""SELECT total, blocked, total - blocked AS allowed, CASE WHEN total > 0 THEN round(blocked * 100.0 / total, 2) ELSE 0 END AS block_rate
    FROM (SELECT count(remote_addr) AS total, count(*) FILTER (WHERE status = 403) AS blocked FROM norm WHERE {_LAST_HOUR}) t""", "shipped_log"),
)
def traffic_totals(spark, sf_dir):
    requests = _requests(spark, sf_dir, "event_ts", "remote_addr", "status")
    return reports.traffic_totals(requests, _newest(spark, sf_dir), hours=48)


@query(
    "top_addresses",
    over_norm(f"""SELECT remote_addr, count(*) AS requests FROM norm WHERE {_LAST_HOUR} GROUP BY remote_addr
    ORDER BY requests DESC, remote_addr LIMIT 10""", "shipped_log"),
)
def top_addresses(spark, sf_dir):
    requests = _requests(spark, sf_dir, "event_ts", "remote_addr", "status")
    return reports.top_addresses(requests, _newest(spark, sf_dir), hours=48)


@query(
    "top_blocked_addresses",
    over_norm(f"""SELECT remote_addr, count(*) AS requests FROM norm WHERE {_LAST_HOUR} AND status = 403 GROUP BY remote_addr
    ORDER BY requests DESC, remote_addr LIMIT 10""", "shipped_log"),
)
def top_blocked_addresses(spark, sf_dir):
    requests = _requests(spark, sf_dir, "event_ts", "remote_addr", "status")
    return reports.top_addresses(requests, _newest(spark, sf_dir), hours=48, blocked_only=True)


@query(
    "requests_over_time",
    over_norm("SELECT date_trunc('hour', event_ts) AS bucket_start, count(*) AS requests FROM norm GROUP BY 1"),
)
def requests_over_time(spark, sf_dir):
    return reports.requests_over_time(_requests(spark, sf_dir, "event_ts", source="access_log"))


_DIMENSIONS = ["edge_server", "status", "cache_status", "logical_client_id", "service"]


@query(
    "request_counts",
    f"WITH {norm_ctes('shipped_log')} "
    + " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value, count(*) AS requests FROM norm GROUP BY {d}" for d in _DIMENSIONS
    ),
)
def request_counts(spark, sf_dir):
    return reports.value_counts(_requests(spark, sf_dir, *_DIMENSIONS), *_DIMENSIONS)


@query(
    "api_event_counts",
    over_norm("SELECT 'event_kind' AS dimension, event_kind AS value, count(*) AS requests FROM norm GROUP BY event_kind", "api_events"),
)
def api_event_counts(spark, sf_dir):
    return reports.value_counts(_requests(spark, sf_dir, "event_kind", source="api_events"), "event_kind")


@query(
    "search_filters",
    over_norm("""SELECT arrival, fold_ts, user_agent, logical_client_id, status, cache_status FROM norm
    WHERE starts_with(user_agent, 'curl') AND status BETWEEN 400 AND 499 AND cache_status = 'HIT'
    UNION ALL SELECT arrival, fold_ts, user_agent, logical_client_id, status, cache_status FROM norm WHERE logical_client_id = 'lc001'""", "shipped_log"),
)
def search_filters(spark, sf_dir):
    requests = _requests(spark, sf_dir, "user_agent", "logical_client_id", "status", "cache_status")
    probes = reports.search_filters(requests, agent_prefix="curl", status_class=4, cache_status="HIT")
    return probes.unionByName(reports.search_filters(requests, client="lc001"))


_BLACKLIST = """, state AS (SELECT type, value FROM (SELECT type, value, last(op ORDER BY seq) AS op FROM blacklist_actions
  WHERE type IN ('ips', 'tokens', 'referers') AND value <> '' GROUP BY type, value) a WHERE op = 'add')"""
_FLAGGED = (
    f"WITH {norm_ctes('shipped_log')}, blacklist_actions AS ({inputs.SQL['blacklist_actions']}){_BLACKLIST}"
    + """, flagged AS (SELECT *, remote_addr IN (SELECT value FROM state WHERE type = 'ips')
      OR http_x_session_token IN (SELECT value FROM state WHERE type = 'tokens')
      OR log_session_token IN (SELECT value FROM state WHERE type = 'tokens')
      OR referer IN (SELECT value FROM state WHERE type = 'referers') AS blocked FROM norm)"""
)


@query(
    "blacklist_state",
    f"WITH blacklist_actions AS ({inputs.SQL['blacklist_actions']}){_BLACKLIST} SELECT * FROM state",
)
def blacklist_state(spark, sf_dir):
    return blocklist.blacklist_state(inputs.load(spark, sf_dir, "blacklist_actions"))


def _flag(spark, sf_dir, *columns):
    needed = {"remote_addr", "http_x_session_token", "log_session_token", "referer", *columns}
    requests = _requests(spark, sf_dir, *sorted(needed))
    return blocklist.blocked_flag(requests, blacklist_state(spark, sf_dir))


@query("blocked_flag", _FLAGGED + " SELECT arrival, remote_addr, referer, blocked FROM flagged")
def blocked_flag(spark, sf_dir):
    return _flag(spark, sf_dir).select("arrival", "remote_addr", "referer", "blocked")


@query(
    "log_search",
    _FLAGGED + """ SELECT arrival, client_ip, content_path, status, blocked FROM flagged
    WHERE blocked AND (contains(remote_addr, 'video_0') OR contains(client_ip, 'video_0') OR contains(content_path, 'video_0') OR contains(user_agent, 'video_0'))
    UNION ALL SELECT arrival, client_ip, content_path, status, blocked FROM flagged WHERE status = 403""",
)
def log_search(spark, sf_dir):
    flagged = _flag(spark, sf_dir, "client_ip", "content_path", "user_agent", "status")
    found = reports.log_search(flagged, "video_0", "blocked").unionByName(reports.log_search(flagged, "", "403"))
    return found.select("arrival", "client_ip", "content_path", "status", "blocked")


_RANGES = "SELECT DISTINCT '192.168.0.' || CAST(150 + s_suppkey * 8 % 104 AS VARCHAR(4)) || '/' || CAST(30 + s_suppkey % 3 AS VARCHAR(4)) AS cidr FROM supplier"


@query(
    "blocked_by_range",
    over_norm(f"""SELECT n.arrival, n.client_ip FROM norm n WHERE EXISTS (SELECT 1 FROM ({_RANGES}) r
      WHERE (CAST(split_part(n.client_ip, '.', 4) AS INT) >> (32 - CAST(split_part(cidr, '/', 2) AS INT)))
        = (CAST(split_part(split_part(cidr, '/', 1), '.', 4) AS INT) >> (32 - CAST(split_part(cidr, '/', 2) AS INT))))"""),
)
def blocked_by_range(spark, sf_dir):
    inputs.given(spark, sf_dir, "supplier").createOrReplaceTempView("supplier")
    requests = _requests(spark, sf_dir, "client_ip", source="access_log")
    return blocklist.blocked_by_range(requests, spark.sql(_RANGES)).select("arrival", "client_ip")


@query(
    "window_metrics",
    over_norm("""SELECT date_trunc('day', event_ts) AS window_start, count(*) AS requests,
      round(count(*) / 86400.0, 6) AS requests_per_sec, round(sum(size) / 1e6 / 86400.0, 6) AS mb_per_sec,
      round(count(*) FILTER (WHERE status >= 400) / count(*), 6) AS error_rate,
      round(count(*) FILTER (WHERE cache_status = 'HIT') / nullif(count(*) FILTER (WHERE cache_status IN ('HIT', 'MISS')), 0), 6) AS cache_hit_ratio,
      round(quantile_cont(delay, 0.5), 3) AS delay_p50_ms, round(quantile_cont(delay, 0.95), 3) AS delay_p95_ms,
      round(quantile_cont(delay, 0.99), 3) AS delay_p99_ms, max(delay) AS lag_ms
      FROM (SELECT *, epoch_ms(ingest_ts) - epoch_ms(event_ts) AS delay FROM norm) d GROUP BY 1""", "shipped_log"),
)
def window_metrics(spark, sf_dir):
    requests = _requests(spark, sf_dir, "event_ts", "ingest_ts", "size", "status", "cache_status")
    return reports.window_metrics(requests, "1 day")


@query(
    "rate_limit_report",
    over_norm("""SELECT second, kind, value, count(*) AS requests FROM (
      SELECT date_trunc('second', event_ts) AS second, 'address' AS kind, client_ip AS value FROM norm
      UNION ALL SELECT date_trunc('second', event_ts), 'token', session_token FROM norm) x
      WHERE value NOT IN ('', '-') GROUP BY ALL HAVING count(*) > 0 AND (kind = 'address' OR count(*) > 1)"""),
)
def rate_limit_report(spark, sf_dir):
    # The test log has few requests per second, so the limits are set where rows exceed them.
    requests = _requests(spark, sf_dir, "event_ts", "client_ip", "session_token", source="access_log")
    return reports.rate_limit_report(requests, per_address=0, per_token=1)


@query(
    "token_features",
    over_rows("""SELECT cdn_token_id, count(DISTINCT CASE WHEN client_ip <> '-' THEN client_ip END) AS clients,
      count(seg_file) AS segment_requests, count(DISTINCT sid) AS segments, min(num) AS first_number, max(num) AS last_number,
      round(count(DISTINCT sid) / nullif(max(num) - min(num) + 1, 0), 6) AS coverage
      FROM (SELECT *, CASE WHEN seg_file IS NOT NULL THEN concat_ws('_', seg_content, seg_resolution, seg_file) END AS sid,
        CAST(nullif(regexp_replace(seg_file, '[^0-9]', '', 'g'), '') AS BIGINT) AS num FROM grows) g WHERE cdn_token_id <> '' GROUP BY cdn_token_id"""),
)
def token_features(spark, sf_dir):
    return reports.token_features(graph_rows(inputs.load(spark, sf_dir, "access_log"), reports.SCENARIO_INPUTS))


@query(
    "client_features",
    over_rows("""SELECT client_ip, count(DISTINCT nullif(cdn_token_id, '')) AS tokens, count(DISTINCT nullif(content_id, '')) AS contents,
      count(*) FILTER (WHERE request_kind = 'playback_start') AS playback_starts FROM grows GROUP BY client_ip"""),
)
def client_features(spark, sf_dir):
    return reports.client_features(graph_rows(inputs.load(spark, sf_dir, "access_log"), reports.SCENARIO_INPUTS))


@query(
    "live_edge_lag",
    over_rows("""SELECT cdn_token_id, content_id, count(*) AS requests, round(avg(edge - num), 6) AS mean_lag, max(edge - num) AS max_lag FROM (
      SELECT *, max(num) OVER (PARTITION BY content_id ORDER BY date_trunc('minute', fold_ts) RANGE UNBOUNDED PRECEDING) AS edge FROM (
        SELECT *, CAST(nullif(regexp_replace(seg_file, '[^0-9]', '', 'g'), '') AS BIGINT) AS num FROM segs
        WHERE starts_with(content_id, 'live_') AND cdn_token_id <> '') a WHERE num IS NOT NULL) b GROUP BY ALL"""),
)
def live_edge_lag(spark, sf_dir):
    rows = graph_rows(inputs.load(spark, sf_dir, "access_log"), reports.SCENARIO_INPUTS)
    return reports.live_edge_lag(rows)


@query(
    "index_page",
    over_norm("""SELECT arrival, event_ts AS index_ts FROM norm WHERE event_ts >= TIMESTAMP '2024-01-10 00:00:00'
    ORDER BY event_ts, arrival LIMIT 500"""),
)
def index_page_query(spark, sf_dir):
    logs = _requests(spark, sf_dir, "event_ts", source="access_log").withColumnRenamed("event_ts", "index_ts")
    return index_page(logs, "2024-01-10T00:00:00Z", 500).select("arrival", "index_ts")


@query(
    "ship_timestamps",
    over_norm("""SELECT arrival, ingest_ts AS shipped, event_ts - INTERVAL 9 HOUR AS with_offset, NULL::TIMESTAMP AS unreadable FROM norm""", "shipped_log"),
)
def ship_timestamps(spark, sf_dir):
    requests = _requests(spark, sf_dir, "timestamp", "event_ts")
    offset = F.concat(F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00"))
    return requests.select(
        "arrival",
        parse_ship_timestamp(F.col("timestamp")).alias("shipped"),
        parse_ship_timestamp(offset).alias("with_offset"),
        parse_ship_timestamp(F.concat(F.col("timestamp"), F.lit("x"))).alias("unreadable"),
    )


_OCTET = "CAST(o_orderkey % 60 AS VARCHAR(4))"
_ADDRESSES = f"""SELECT o_orderkey AS id, CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN '::ffff:192.168.0.' || {_OCTET}
  WHEN 1 THEN '192.168.0.' || {_OCTET} || ', 10.0.0.1' WHEN 2 THEN '192.168.' || CAST(o_orderkey % 5 * 10 AS VARCHAR(4)) || '.7'
  WHEN 3 THEN '192.168.0.' || {_OCTET} ELSE '10.1.1.300' END AS client_ip,
  CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN ' EDGE-KR ' WHEN 1 THEN 'edge-jp' WHEN 2 THEN 'edge-xx' ELSE '' END AS edge_id FROM orders"""
_EDGES = """SELECT 'edge-' || r AS edge_id, upper(r) AS region, 'http://' || r || '.test' AS url FROM (
  SELECT DISTINCT CASE n_nationkey % 3 WHEN 0 THEN 'kr' WHEN 1 THEN 'jp' ELSE 'sg' END AS r FROM nation) x"""


@query(
    "edge_choice",
    f"""WITH a AS ({_ADDRESSES}), e AS ({_EDGES}),
    b AS (SELECT *, regexp_replace(trim(split_part(client_ip, ',', 1)), '^::ffff:', '') AS ip FROM a),
    c AS (SELECT *, CASE WHEN ip LIKE '192.168.0.%' AND CAST(split_part(ip, '.', 4) AS INT) BETWEEN 11 AND 19 THEN 'KR'
      WHEN ip LIKE '192.168.0.%' AND CAST(split_part(ip, '.', 4) AS INT) BETWEEN 21 AND 29 THEN 'JP'
      WHEN ip LIKE '192.168.0.%' AND CAST(split_part(ip, '.', 4) AS INT) BETWEEN 31 AND 39 THEN 'SG'
      WHEN ip LIKE '192.168.0.%' AND CAST(split_part(ip, '.', 4) AS INT) BETWEEN 41 AND 49 THEN 'US'
      WHEN ip LIKE '192.168.10.%' THEN 'KR' WHEN ip LIKE '192.168.20.%' THEN 'JP' WHEN ip LIKE '192.168.30.%' THEN 'SG'
      WHEN ip LIKE '192.168.40.%' THEN 'US' ELSE 'UNKNOWN' END AS ip_region FROM b)
    SELECT c.id, ip, ip_region, coalesce(x.edge_id, y.edge_id, 'edge-local') AS chosen_edge, coalesce(x.region, ip_region) AS chosen_region,
      coalesce(x.url, y.url, 'http://default.test') AS chosen_url
    FROM c LEFT JOIN e x ON lower(trim(c.edge_id)) = x.edge_id LEFT JOIN e y ON y.region = c.ip_region""",
)
def edge_choice_query(spark, sf_dir):
    for name in ("orders", "nation"):
        inputs.given(spark, sf_dir, name).createOrReplaceTempView(name)
    chosen = edge_choice.edge_for(spark.sql(_ADDRESSES), spark.sql(_EDGES), "edge-local", "http://default.test")
    return chosen.select(
        "id", identity.normalize_ip(F.col("client_ip")).alias("ip"), identity.region_from_ip(F.col("client_ip")).alias("ip_region"),
        "chosen_edge", "chosen_region", "chosen_url",
    )


