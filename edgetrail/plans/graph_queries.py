"""Normalization, node and edge tables, statistics and graph reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import edges, legacy, nodes, reports
from ..operators.correlation import INPUTS as CORRELATION_INPUTS
from ..operators.correlation import ip_correlation, ip_paths, ip_similarity, shared_tokens
from ..operators.graph_rows import graph_rows
from ..operators.normalize import REQUEST_COLUMNS, normalize_requests
from ..operators.quality import replay_summary
from ..session import materialize, scratch_path
from ..sources import sinks
from . import inputs
from .oracle import NODES_AND_EDGES, first, last, over_norm, over_rows, resource
from .registry import query


def _rows(spark: SparkSession, sf_dir: str, columns, source: str = "access_log") -> DataFrame:
    return graph_rows(inputs.load(spark, sf_dir, source), columns)


_NORM_SELECT = """SELECT arrival, fold_ts, timestamp, account_id, user_id, username, client_ip, client_region, edge_server,
  domain, session_token, cdn_token_given AS cdn_token_id, playback_session_id, run_id, scenario_id, label, dataset_label,
  device_given AS device_id, logical_client_id, physical_host_id, network_profile_id, token_content_id, token_issued_at,
  token_expires, token_ttl_sec, token_ttl_remaining_sec, token_valid_text AS token_valid, token_edge_match, referer,
  query_content_id, content_path, content_title, content_filename, method, status, size, response_time_ms, cache_status, request_log_id,
  user_agent, resource_type, resource_category, connection_id, connection_requests, http_range, keep_alive, http_accept,
  http_accept_language FROM norm"""
_NORM_COLUMNS = [c for c in REQUEST_COLUMNS if c != "query_params"] + ["query_content_id"]


def _normalized(source: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return normalize_requests(inputs.load(spark, sf_dir, source), _NORM_COLUMNS)

    return run


for _name, _source in (
    ("normalize_requests", "access_log"),
    ("normalize_shipped_log", "shipped_log"),
    ("normalize_api_events", "api_events"),
):
    query(_name, over_norm(_NORM_SELECT, _source))(_normalized(_source))


@query(
    "query_parameters",
    over_norm(
        """SELECT arrival, split_part(pair, '=', 1) AS name,
        url_decode(replace(split_part(pair, '=', 2), '+', '%20')) AS value
        FROM (SELECT arrival, unnest(string_split(qs, '&')) AS pair FROM with_qs WHERE qs <> '') p""",
        "api_events",
    ),
)
def query_parameters(spark, sf_dir):
    rows = normalize_requests(inputs.load(spark, sf_dir, "api_events"), ["query_params"])
    return rows.select("arrival", F.explode("query_params").alias("name", "value"))


@query(
    "classify_requests",
    over_rows(
        """SELECT arrival, request_kind, content_id, content_type, device_type, device_id, referrer_domain,
        referrer_category, referrer_category = 'legitimate' AS referrer_legitimate, edge_region, label FROM grows"""
    ),
)
def classify_requests(spark, sf_dir):
    columns = [
        "request_kind", "content_id", "content_type", "device_type", "device_id", "referrer_domain",
        "referrer_category", "referrer_legitimate", "edge_region", "label",
    ]
    return _rows(spark, sf_dir, columns).drop("fold_ts")


_RTYPE, _RCAT = resource("url")


@query(
    "page_urls",
    f"""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS domain, 'foreign' AS category, false AS is_legitimate,
    {_RTYPE} AS type, {_RCAT} AS resource_category,
    nullif(regexp_extract(split_part(url, '?', 1), '([^/]*)$', 1), '') AS filename, split_part(url, '?', 1) AS without_query,
    coalesce(nullif(string_split(trim(url, '/'), '/')[2], NULL), 'unknown') AS title FROM pages""",
)
def page_urls(spark, sf_dir):
    pages = inputs.given(spark, sf_dir, "pages")
    rows = pages.select("page_id", "url", urls.referrer(F.col("url")).alias("r"), urls.resource_type(F.col("url")).alias("t"))
    return rows.select(
        "page_id", "r.domain", "r.category", "r.is_legitimate", "t.type", F.col("t.category").alias("resource_category"),
        urls.path_filename(F.col("url")).alias("filename"), urls.strip_query(F.col("url")).alias("without_query"),
        urls.path_title(F.col("url")).alias("title"),
    )


# --- nodes ---------------------------------------------------------------------------------

_RUN = ", ".join(f"{last(c)} AS {c}" for c in ("run_id", "scenario_id", "dataset_label", "label"))
_IDENT = ", ".join(
    f"""{last(c, f"{c} <> '-'")} AS {c}""" for c in ("device_id", "logical_client_id", "physical_host_id", "network_profile_id")
)
_TOKEN_TIMES = ", ".join(f"""{last(c, f"{c} <> '-'")} AS {c}""" for c in ("token_issued_at", "token_expires"))
_TTL = f"coalesce({last('token_ttl_sec', 'token_ttl_sec <> 0')}, 0) AS token_ttl_sec"
_APP = f"""{last('app_session_id', "app_session_id <> '-'")} AS app_session_id"""
_KNOWN_CONTENT = "content_id <> ''"

NODE_CHECKS = {
    "Request": f"""SELECT request_id, {first('fold_ts')} AS first_seen, {last('fold_ts')} AS timestamp, {last('method')} AS method,
      {last('request_path')} AS path, {last('request_kind')} AS kind, {last("nullif(content_id, '')")} AS target_content_id,
      {last("nullif(cdn_token_id, '')")} AS cdn_token_id, {last("nullif(app_session_id, '-')")} AS app_session_id,
      {last('edge_id')} AS edge_id, {last("nullif(client_ip, '-')")} AS client_ip, {last('referrer_domain')} AS referrer_domain,
      {last('referer')} AS referer, {last('status')} AS status, {last('bytes_sent')} AS bytes_sent,
      {last('response_time_ms')} AS response_time_ms, {last('cache_status')} AS cache_status, {last('range_header')} AS range_header,
      {last('keep_alive')} AS keep_alive, {last('user_agent')} AS user_agent, {_RUN}, {last('token_ttl_sec')} AS token_ttl_sec,
      {last('token_ttl_remaining_sec')} AS token_ttl_remaining_sec, {_TOKEN_TIMES}, {_IDENT} FROM grows GROUP BY request_id""",
    "Content": f"""SELECT content_id, content_id AS title, {first('content_type')} AS type, min(fold_ts) AS first_accessed,
      max(fold_ts) AS last_accessed, count(*) AS request_count, CAST(sum(bytes_sent) AS BIGINT) AS total_bytes
      FROM grows WHERE content_id <> '' GROUP BY content_id""",
    "ViewingSession": f"""SELECT viewing_session_id, min(fold_ts) AS start_time, max(fold_ts) AS last_time, max(fold_ts) AS end_time, {_RUN}, {_APP},
      {last('account_id', "account_id <> '-'")} AS account_id, {_TOKEN_TIMES}, {_IDENT},
      {last('content_id', _KNOWN_CONTENT)} AS content_id, {last('content_type', _KNOWN_CONTENT)} AS content_type, {_TTL},
      count(*) AS request_count,
      count(*) FILTER (WHERE request_kind = 'hls_manifest') AS total_manifest_requests,
      count(*) FILTER (WHERE request_kind = 'hls_segment') AS total_segment_requests,
      count(*) FILTER (WHERE request_kind = 'playback_start') AS total_playback_start_requests,
      count(*) FILTER (WHERE request_kind = 'browse_content') AS total_browse_requests,
      CAST(sum(bytes_sent) AS BIGINT) AS total_bytes, bool_or(content_type = 'live') AS is_live,
      bool_or(request_kind = 'browse_content') AS has_browse, bool_or(request_kind = 'playback_start') AS has_playback_start,
      bool_or(request_kind = 'playback_start' AND browses_before = 0) AS playback_without_browse
      FROM (SELECT *, count(*) FILTER (WHERE request_kind = 'browse_content') OVER (PARTITION BY viewing_session_id ORDER BY fold_ts, arrival
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS browses_before FROM grows) r GROUP BY viewing_session_id""",
    "Account": f"""SELECT account_id, min(fold_ts) AS created_at, max(fold_ts) AS last_seen,
      coalesce({last('username', "username <> '-'")}, '-') AS username, coalesce({last('user_id', "user_id <> '-'")}, '-') AS user_id,
      'basic' AS tier, 'normal' AS status FROM grows WHERE account_id <> '-' GROUP BY account_id""",
    "CdnToken": f"""SELECT cdn_token_id, min(fold_ts) AS first_seen, {first('left(token, 12)')} AS token_prefix, max(fold_ts) AS last_seen,
      {_RUN}, {last('token_valid')} AS valid, {_APP}, {_TOKEN_TIMES}, {_IDENT}, {last('content_id', _KNOWN_CONTENT)} AS content_id, {_TTL}
      FROM grows WHERE cdn_token_id <> '' GROUP BY cdn_token_id""",
    "ClientIP": """SELECT client_ip AS ip_address, min(fold_ts) AS first_seen, max(fold_ts) AS last_seen
      FROM grows WHERE client_ip NOT IN ('', '-') GROUP BY client_ip""",
    "Device": f"""SELECT device_id, min(fold_ts) AS first_seen, {first('user_agent')} AS user_agent, {first('device_type')} AS device_type,
      max(fold_ts) AS last_seen FROM grows GROUP BY device_id""",
    "Edge": f"""SELECT edge_id, min(fold_ts) AS first_seen, max(fold_ts) AS last_seen, {last('edge_region')} AS region
      FROM grows GROUP BY edge_id""",
    "Referrer": f"""SELECT referrer_domain AS domain, min(fold_ts) AS first_seen, max(fold_ts) AS last_seen,
      {last('referrer_category')} AS category, {last("referrer_category = 'legitimate'")} AS is_legitimate FROM grows GROUP BY referrer_domain""",
    "Segment": f"""SELECT segment_id, {first('seg_file')} AS filename, {first("CAST(nullif(regexp_replace(seg_file, '[^0-9]', '', 'g'), '') AS BIGINT)")} AS number,
      {first('seg_resolution')} AS resolution, {first('request_path')} AS path, min(fold_ts) AS first_accessed, max(fold_ts) AS last_accessed,
      max(bytes_sent) AS size_bytes FROM segs GROUP BY segment_id""",
}

NODE_QUERIES = {
    "Request": "graph_nodes_request", "Content": "graph_nodes_content", "ViewingSession": "viewing_sessions",
    "Account": "graph_nodes_account", "CdnToken": "graph_nodes_token", "ClientIP": "graph_nodes_ip",
    "Device": "graph_nodes_device", "Edge": "graph_nodes_edge", "Referrer": "graph_nodes_referrer",
    "Segment": "graph_nodes_segment",
}


def _node_query(label: str, source: str = "access_log"):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return nodes.nodes(_rows(spark, sf_dir, nodes.NODE_INPUTS[label], source), label)

    return run


for _label, _name in NODE_QUERIES.items():
    query(_name, over_rows(NODE_CHECKS[_label]))(_node_query(_label))
# The API's own events carry typed values, token hashes and labels the edge log lacks.
query("viewing_sessions_api", over_rows(NODE_CHECKS["ViewingSession"], "api_events"))(_node_query("ViewingSession", "api_events"))
query("graph_nodes_token_api", over_rows(NODE_CHECKS["CdnToken"], "api_events"))(_node_query("CdnToken", "api_events"))


# --- edges and statistics ------------------------------------------------------------------


@query("graph_edges", over_rows("").rstrip() + "," + NODES_AND_EDGES + " SELECT * FROM pairs")
def graph_edges(spark, sf_dir):
    return edges.edges_unified(_rows(spark, sf_dir, edges.EDGE_INPUTS))


@query(
    "graph_statistics",
    over_rows("").rstrip() + "," + NODES_AND_EDGES + """
    SELECT 'Relationships' AS name, count(*) AS count FROM pairs
    UNION ALL SELECT label, count(DISTINCT id) FROM (
      SELECT 'Request' AS label, request_id AS id FROM grows UNION ALL SELECT 'Content', nullif(content_id, '') FROM grows
      UNION ALL SELECT 'ViewingSession', viewing_session_id FROM grows UNION ALL SELECT 'Account', nullif(account_id, '-') FROM grows
      UNION ALL SELECT 'CdnToken', nullif(cdn_token_id, '') FROM grows UNION ALL SELECT 'ClientIP', nullif(client_ip, '-') FROM grows
      UNION ALL SELECT 'Device', device_id FROM grows UNION ALL SELECT 'Edge', edge_id FROM grows
      UNION ALL SELECT 'Referrer', referrer_domain FROM grows UNION ALL SELECT 'Segment', segment_id FROM segs) n GROUP BY label""",
)
def graph_statistics(spark, sf_dir):
    return edges.graph_statistics(_rows(spark, sf_dir, edges.EDGE_INPUTS))


def _edge_query(type_: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return edges.edges(_rows(spark, sf_dir, edges.EDGE_INPUTS), type_)

    return run


for _type in ("USES_CDN_TOKEN", "TARGETS_CONTENT", "FOR_SEGMENT", "BELONGS_TO"):
    query(
        f"edges_{_type.lower()}",
        over_rows("").rstrip() + "," + NODES_AND_EDGES + f" SELECT src, dst FROM pairs WHERE type = '{_type}'",
    )(_edge_query(_type))


# --- token and address reports -------------------------------------------------------------

_MEMBERS = """,
ts AS (SELECT DISTINCT cdn_token_id AS token, viewing_session_id FROM grows WHERE cdn_token_id <> ''),
members AS (
  SELECT ts.token, 'account' AS kind, account_id AS value FROM ts JOIN grows USING (viewing_session_id) WHERE account_id <> '-'
  UNION SELECT ts.token, 'content', content_id FROM ts JOIN grows USING (viewing_session_id) WHERE content_id <> ''
  UNION SELECT ts.token, 'ip', client_ip FROM ts JOIN grows USING (viewing_session_id) WHERE client_ip NOT IN ('', '-')
  UNION SELECT ts.token, 'referrer', referrer_domain FROM ts JOIN grows USING (viewing_session_id)),
fanout AS (SELECT token, count(*) FILTER (WHERE kind = 'account') AS account_count, count(*) FILTER (WHERE kind = 'content') AS content_count,
  count(*) FILTER (WHERE kind = 'ip') AS ip_count, count(*) FILTER (WHERE kind = 'referrer') AS referrer_count
  FROM members GROUP BY token HAVING ip_count > 2 OR referrer_count > 1)"""


@query("token_fanout", over_rows("").rstrip() + _MEMBERS + " SELECT * FROM fanout")
def token_fanout(spark, sf_dir):
    found = reports.token_fanout(_rows(spark, sf_dir, reports.FANOUT_INPUTS))
    return found.orderBy(F.desc("ip_count"), F.desc("referrer_count"), "token")


@query(
    "token_fanout_members",
    over_rows("").rstrip() + _MEMBERS + " SELECT m.* FROM members m WHERE token IN (SELECT token FROM fanout)",
)
def token_fanout_members(spark, sf_dir):
    return reports.token_fanout_members(_rows(spark, sf_dir, reports.FANOUT_INPUTS))


@query(
    "suspicious_sessions",
    over_rows("").rstrip() + _MEMBERS + """ SELECT DISTINCT viewing_session_id, client_ip FROM grows
    WHERE client_ip NOT IN ('', '-') AND viewing_session_id IN (SELECT viewing_session_id FROM ts WHERE token IN (SELECT token FROM fanout))""",
)
def suspicious_sessions(spark, sf_dir):
    return reports.suspicious_sessions(_rows(spark, sf_dir, reports.FANOUT_INPUTS))


@query(
    "token_ip_count",
    over_rows("""SELECT cdn_token_id, count(DISTINCT client_ip) AS ip_count FROM grows
    WHERE cdn_token_id <> '' AND client_ip <> '-' GROUP BY cdn_token_id HAVING count(DISTINCT client_ip) > 2"""),
)
def token_ip_count(spark, sf_dir):
    return legacy.token_ip_count(_rows(spark, sf_dir, ["cdn_token_id", "client_ip"]), threshold=2)


@query(
    "bad_referrer_report",
    over_rows("""SELECT referrer_domain, count(DISTINCT client_ip) AS unique_ips, count(*) AS request_count
    FROM (SELECT DISTINCT referrer_domain, client_ip FROM grows WHERE referrer_category <> 'legitimate' AND client_ip <> '-') a
    JOIN (SELECT DISTINCT client_ip, content_id FROM grows WHERE content_id <> '') b USING (client_ip) GROUP BY referrer_domain"""),
)
def bad_referrer_report(spark, sf_dir):
    return legacy.bad_referrer_report(
        _rows(spark, sf_dir, ["client_ip", "content_id", "referrer_domain", "referrer_legitimate"])
    )


@query(
    "ip_behaviour",
    over_rows("""SELECT 'Token' AS target_type, 'USED_TOKEN' AS relationship, count(DISTINCT nullif(cdn_token_id, '')) AS count FROM grows WHERE client_ip = '192.168.0.160'
    UNION ALL SELECT 'Referer', 'FROM_REFERER', count(DISTINCT referrer_domain) FROM grows WHERE client_ip = '192.168.0.160'
    UNION ALL SELECT 'Content', 'ACCESSED', count(DISTINCT nullif(content_id, '')) FROM grows WHERE client_ip = '192.168.0.160'"""),
)
def ip_behaviour(spark, sf_dir):
    rows = _rows(spark, sf_dir, ["client_ip", "cdn_token_id", "referrer_domain", "content_id"])
    return legacy.ip_behaviour(rows, "192.168.0.160")


_ASN = "CASE WHEN CAST(split_part(client_ip, '.', 4) AS INT) % 5 = 0 THEN 'hosting' WHEN CAST(split_part(client_ip, '.', 4) AS INT) % 5 = 1 THEN 'mobile' ELSE 'residential' END"


def _networks(rows: DataFrame) -> DataFrame:
    """Network type of each address in the log, by its last octet."""
    return rows.where("client_ip <> '-'").select(F.col("client_ip").alias("ip_address"), F.expr(_ASN).alias("asn_type")).distinct()


@query(
    "asn_distribution",
    over_rows(f"""SELECT cdn_token_id, string_agg(asn_type || '=' || n, ',' ORDER BY asn_type) AS distribution FROM (
      SELECT cdn_token_id, {_ASN} AS asn_type, count(DISTINCT client_ip) AS n FROM grows WHERE cdn_token_id <> '' AND client_ip <> '-' GROUP BY ALL) x
    GROUP BY cdn_token_id"""),
)
def asn_distribution(spark, sf_dir):
    rows = materialize(_rows(spark, sf_dir, ["cdn_token_id", "client_ip"]), "token-addresses")
    lists = legacy.asn_distribution(rows, _networks(rows))
    text = F.transform("asn_distribution", lambda x: F.concat(x["asn_type"], F.lit("="), x["count"].cast("string")))
    return lists.select("cdn_token_id", F.array_join(text, ",").alias("distribution"))


_STARTS = f"(SELECT DISTINCT client_ip AS ip FROM grows WHERE {_ASN} = 'hosting')"


@query(
    "ip_correlation",
    over_rows("").rstrip() + f""",
    items AS (SELECT 'token' AS kind, cdn_token_id AS value, client_ip AS ip, fold_ts FROM grows WHERE cdn_token_id <> '' AND client_ip <> '-'
      UNION ALL SELECT 'referrer', referrer_domain, client_ip, fold_ts FROM grows WHERE client_ip <> '-'),
    d AS (SELECT DISTINCT kind, value, ip FROM items),
    span AS (SELECT ip, count(DISTINCT (kind, value)) AS n, min(fold_ts) AS a, max(fold_ts) AS b FROM items GROUP BY ip),
    shared AS (SELECT x.ip AS ip1, y.ip AS ip2, count(*) FILTER (WHERE kind = 'token') AS shared_tokens,
      count(*) FILTER (WHERE kind = 'referrer') AS shared_referers
      FROM d x JOIN d y USING (kind, value) WHERE x.ip <> y.ip AND x.ip IN {_STARTS} GROUP BY ALL)
    SELECT ip1, ip2, shared_tokens, shared_referers,
      greatest(CAST(epoch(least(s1.b, s2.b)) - epoch(greatest(s1.a, s2.a)) AS BIGINT), 0) AS overlap_sec,
      round((shared_tokens + shared_referers) / (s1.n + s2.n - shared_tokens - shared_referers), 6) AS score
    FROM shared JOIN span s1 ON s1.ip = ip1 JOIN span s2 ON s2.ip = ip2 WHERE shared_tokens > 0""",
)
def ip_correlation_query(spark, sf_dir):
    rows = materialize(_rows(spark, sf_dir, CORRELATION_INPUTS), "addresses")
    starts = _networks(rows).where("asn_type = 'hosting'").select(F.col("ip_address").alias("ip"))
    return ip_correlation(rows, starts)


@query(
    "ip_paths",
    over_rows("").rstrip() + f""",
    d AS (SELECT DISTINCT cdn_token_id AS value, client_ip AS ip FROM grows WHERE cdn_token_id <> '' AND client_ip <> '-'),
    e AS (SELECT DISTINCT x.ip AS a, y.ip AS b FROM d x JOIN d y USING (value) WHERE x.ip <> y.ip),
    p AS (SELECT a AS start, b AS ip, 1 AS hops FROM e UNION ALL SELECT x.a, y.b, 2 FROM e x JOIN e y ON x.b = y.a WHERE x.a <> y.b)
    SELECT start, ip, min(hops) AS hops FROM p WHERE start IN {_STARTS} GROUP BY ALL""",
)
def ip_paths_query(spark, sf_dir):
    rows = materialize(_rows(spark, sf_dir, CORRELATION_INPUTS), "addresses")
    starts = _networks(rows).where("asn_type = 'hosting'").select(F.col("ip_address").alias("ip"))
    return ip_paths(rows, starts)


_LEAST = 0.1
_SETS = """,
    d AS (SELECT DISTINCT kind, value, ip FROM (SELECT 'token' AS kind, cdn_token_id AS value, client_ip AS ip FROM grows WHERE cdn_token_id <> '' AND client_ip <> '-'
      UNION ALL SELECT 'referrer', referrer_domain, client_ip FROM grows WHERE client_ip <> '-') x),
    s AS (SELECT ip, string_agg(kind || ':' || value, '|' ORDER BY kind, value) AS own, count(*) AS items FROM d GROUP BY ip),
    c AS (SELECT ip, min(ip) OVER (PARTITION BY own) AS cls, items FROM s)"""


@query("ip_classes", over_rows("").rstrip() + _SETS + " SELECT ip, cls, items FROM c")
def ip_classes(spark, sf_dir):
    """Addresses with exactly the same tokens and referrers, by their least address."""
    return ip_similarity(_rows(spark, sf_dir, CORRELATION_INPUTS), _LEAST)[0]


@query(
    "ip_correlation_all",
    over_rows("").rstrip() + _SETS + f""",
    p AS (SELECT x.ip AS cls1, y.ip AS cls2, count(*) FILTER (WHERE kind = 'token') AS shared_tokens, count(*) FILTER (WHERE kind = 'referrer') AS shared_referers
      FROM d x JOIN d y USING (kind, value) WHERE x.ip < y.ip AND x.ip IN (SELECT cls FROM c) AND y.ip IN (SELECT cls FROM c) GROUP BY ALL)
    SELECT cls1, cls2, shared_tokens, shared_referers, round((shared_tokens + shared_referers) / (a.items + b.items - shared_tokens - shared_referers), 6) AS score
    FROM p JOIN c a ON a.ip = cls1 JOIN c b ON b.ip = cls2
    WHERE (shared_tokens + shared_referers) / (a.items + b.items - shared_tokens - shared_referers) >= {_LEAST}""",
)
def ip_correlation_all(spark, sf_dir):
    """All pairs of address classes with a score of at least 0.1, over the whole log."""
    return ip_similarity(_rows(spark, sf_dir, CORRELATION_INPUTS), _LEAST)[1]


@query(
    "shared_tokens",
    over_rows("""SELECT ip, count(*) AS tokens, count(*) FILTER (WHERE n > 1) AS shared_tokens, max(n) AS largest_group FROM (
      SELECT DISTINCT client_ip AS ip, cdn_token_id FROM grows WHERE cdn_token_id <> '' AND client_ip <> '-') x
      JOIN (SELECT cdn_token_id, count(DISTINCT client_ip) AS n FROM grows WHERE client_ip <> '-' GROUP BY ALL) y USING (cdn_token_id) GROUP BY ip"""),
)
def shared_tokens_query(spark, sf_dir):
    return shared_tokens(_rows(spark, sf_dir, CORRELATION_INPUTS))


# --- legacy graph --------------------------------------------------------------------------

_LEGACY_HOURS = 6.0
_LEGACY_CTE = over_norm("", "shipped_log").rstrip() + f""",
page AS (SELECT * FROM norm WHERE fold_ts >= (SELECT max(fold_ts) FROM norm) - INTERVAL {int(_LEGACY_HOURS)} HOUR),
slice AS (SELECT remote_addr AS address, nullif(http_x_session_token, '') AS token, split_part(list_last(string_split(referer, '//')), '/', 1) AS domain,
  nullif(split_part(split_part(content_path, '/hls/', 2), '.', 1), '') AS content, fold_ts AS seen_at, arrival FROM page)"""


def _legacy_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = inputs.load(spark, sf_dir, "shipped_log")
    columns = ["remote_addr", "http_x_session_token", "referer", "content_path"]
    requests = normalize_requests(logs, columns)
    as_of = reports.newest(normalize_requests(logs, []), "fold_ts")
    return legacy.recent_slice(requests, as_of, _LEGACY_HOURS)


_LEGACY_LAST = "CASE WHEN count(*) > 1 THEN min(seen_at) END"


@query(
    "legacy_graph_edges",
    _LEGACY_CTE + f"""
    SELECT 'USED_TOKEN' AS type, address AS src, token AS dst, max(seen_at) AS first, {_LEGACY_LAST} AS last FROM slice WHERE token IS NOT NULL GROUP BY address, token
    UNION ALL SELECT 'FROM_REFERER', address, domain, NULL, NULL FROM slice WHERE domain IS NOT NULL GROUP BY address, domain
    UNION ALL SELECT 'ACCESSED', token, content, max(seen_at), {_LEGACY_LAST} FROM slice WHERE token IS NOT NULL AND content IS NOT NULL GROUP BY token, content""",
)
def legacy_graph_edges(spark, sf_dir):
    graph = legacy.legacy_graph(_legacy_page(spark, sf_dir))
    nothing = F.lit(None).cast("timestamp")
    used = graph["USED_TOKEN"].select(F.lit("USED_TOKEN").alias("type"), "src", "dst", F.col("first_used").alias("first"), F.col("last_used").alias("last"))
    referer = graph["FROM_REFERER"].select(F.lit("FROM_REFERER").alias("type"), "src", "dst", nothing.alias("first"), nothing.alias("last"))
    accessed = graph["ACCESSED"].select(F.lit("ACCESSED").alias("type"), "src", "dst", F.col("first_access").alias("first"), F.col("last_access").alias("last"))
    return used.unionByName(referer).unionByName(accessed)


@query(
    "legacy_graph_nodes",
    _LEGACY_CTE + f"""
    SELECT 'IPAddress' AS label, address AS id, max(seen_at) AS first, {_LEGACY_LAST} AS last FROM slice GROUP BY address
    UNION ALL SELECT 'Token', token, max(seen_at), NULL FROM slice WHERE token IS NOT NULL GROUP BY token
    UNION ALL SELECT DISTINCT 'Referer', domain, NULL::TIMESTAMP, NULL::TIMESTAMP FROM slice WHERE domain IS NOT NULL
    UNION ALL SELECT DISTINCT 'Content', content, NULL::TIMESTAMP, NULL::TIMESTAMP FROM slice WHERE token IS NOT NULL AND content IS NOT NULL""",
)
def legacy_graph_nodes(spark, sf_dir):
    graph = legacy.legacy_graph(_legacy_page(spark, sf_dir))
    none = F.lit(None).cast("timestamp")
    parts = [
        graph["IPAddress"].select(F.lit("IPAddress").alias("label"), F.col("address").alias("id"), F.col("first_seen").alias("first"), F.col("last_seen").alias("last")),
        graph["Token"].select(F.lit("Token").alias("label"), F.col("value").alias("id"), F.col("created_at").alias("first"), none.alias("last")),
        graph["Referer"].select(F.lit("Referer").alias("label"), F.col("domain").alias("id"), none.alias("first"), none.alias("last")),
        graph["Content"].select(F.lit("Content").alias("label"), "id", none.alias("first"), none.alias("last")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- replay and sink -----------------------------------------------------------------------

# For the check: what counts as a node of each label, and which labels have counters that add up.
_COUNTED = {"Content": "request_count", "ViewingSession": "request_count"}
_REPLAY_CHECK = " UNION ALL ".join(
    f"SELECT '{label}' AS label, CAST(count(*) AS BIGINT) AS nodes, 0 AS changed, {'count(*)' if label in _COUNTED else '0'} AS doubled FROM ({NODE_CHECKS[label]}) {label.lower()}_nodes"
    for label in nodes.NODE_FOLDS
)


@query("replay_check", over_rows(_REPLAY_CHECK))
def replay_check(spark, sf_dir):
    """Fold a batch once, and as two deliveries that are merged: nodes stay equal, counters double."""
    columns = sorted({c for used in nodes.NODE_INPUTS.values() for c in used})
    rows = materialize(_rows(spark, sf_dir, columns), "replay-rows")
    out = None
    for label, fold in nodes.NODE_FOLDS.items():
        once = materialize(fold.partial(rows), f"replay-{label}")
        twice = fold.merge(once.unionByName(once))
        part = replay_summary(fold.result(once), fold.result(twice), fold.key, list(fold.sums)).select(F.lit(label).alias("label"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "graph_sink",
    over_rows("").rstrip() + "," + NODES_AND_EDGES + " SELECT type, count(*) AS edges FROM pairs GROUP BY type",
)
def graph_sink(spark, sf_dir):
    path = scratch_path(spark, "graph")
    sinks.sink_graph(_rows(spark, sf_dir, None), path)
    return spark.read.parquet(f"{path}/edges").groupBy("type").agg(F.count("*").alias("edges"))
