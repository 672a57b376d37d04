"""Input tables of the registered queries, derived from the given Parquet tables.

Each text is one SELECT that Spark and DuckDB both run, so a query and its check read the same
rows.  Everything is computed row by row (and one join), so it grows with the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import dealt, spread

GIVEN = ["events", "customer", "orders", "lineitem", "part", "pages"]

ACCESS_LOG = """
WITH e AS (
  SELECT event_id, user_id, event_type, value,
         replace(CAST(date_trunc('second', ts) AS VARCHAR(32)), ' ', 'T') || 'Z' AS iso_ts,
         CAST(day(ts) AS INT) AS d,
         CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k
  FROM events),
c AS (
  SELECT *, CASE WHEN k % 16 < 13 THEN 'video_' || lpad(CAST(k % 13 + 1 AS VARCHAR(8)), 2, '0')
                 ELSE 'live_0' || CAST(k % 3 + 1 AS VARCHAR(8)) END AS content_id,
         CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'edge-kr' WHEN 1 THEN 'edge-jp'
              WHEN 2 THEN 'edge-sg' ELSE 'edge-us' END AS edge,
         'tok-' || CAST(user_id AS VARCHAR(20)) || '-' || CAST(d AS VARCHAR(8)) AS token
  FROM e),
p AS (
  SELECT *,
    CASE event_type WHEN 'view' THEN '/api/browse/content/' || content_id
                    WHEN 'purchase' THEN '/api/playback/start'
                    WHEN 'signup' THEN '/hls/' || content_id || '/master.m3u8'
                    ELSE '/hls/' || content_id || CASE WHEN k % 2 = 0 THEN '/720p/' ELSE '/1080p/' END
                         || 'seg_' || lpad(CAST(k AS VARCHAR(8)), 5, '0') || '.ts' END AS path,
    CASE WHEN event_type = 'view' THEN 'device=dev-' || CAST(user_id AS VARCHAR(20))
         ELSE 'token=' || token || '&user_id=' || CAST(user_id AS VARCHAR(20)) END
      || CASE WHEN user_id % 3 = 0 THEN '&run_id=run-' || CAST(user_id AS VARCHAR(20)) || '-' || CAST(d AS VARCHAR(8)) ELSE '' END
      || CASE WHEN event_type = 'purchase' THEN '&content_id=' || content_id ELSE '' END AS qs,
    CASE CAST(event_id % 11 AS INT) WHEN 0 THEN '-'
         WHEN 1 THEN 'https://rebroadcast' || CAST(user_id % 3 AS VARCHAR(8)) || '.example.com/x'
         WHEN 2 THEN 'chrome-extension://abc' ELSE 'https://www.myott.com/watch/' || content_id END AS referer
  FROM c)
SELECT event_id AS arrival,
  '{"timestamp":"' || iso_ts
  || '","client_ip":"192.168.0.' || CAST(151 + (user_id + CASE WHEN event_id % 7 = 0 THEN event_id % 5 ELSE 0 END) % 100 AS VARCHAR(8))
  || '","edge_server":"' || edge
  || '","request_method":"' || CASE WHEN event_type = 'purchase' THEN 'POST' ELSE 'GET' END
  || '","request_uri":"' || path || '?' || qs || '","query_string":"' || qs
  || '","status":"' || CASE WHEN event_type = 'error' THEN CASE WHEN k % 2 = 0 THEN '403' ELSE '503' END ELSE '200' END
  || '","bytes_sent":"' || CAST(k * 1000 AS VARCHAR(12))
  || '","response_time_ms":"0.' || lpad(CAST(k AS VARCHAR(4)), 3, '0')
  || '","cache_status":"' || CASE CAST(k % 3 AS INT) WHEN 0 THEN 'HIT' WHEN 1 THEN 'MISS' ELSE '-' END
  || '","http_referer":"' || referer
  || '","http_user_agent":"' || CASE CAST(user_id % 4 AS INT) WHEN 0 THEN 'curl/8.0' WHEN 1 THEN 'Mozilla/5.0 Chrome/120'
        WHEN 2 THEN 'Mozilla/5.0 (iPhone)' ELSE 'Mozilla/5.0 (SMART-TV; Tizen)' END
  || '","request_id":"' || CAST(event_id AS VARCHAR(20)) || '"}' AS raw
FROM p
"""

# The log as a shipper delivers it: the record nested under "json", fields of the shipper outside.
SHIPPED_LOG = f"""
SELECT arrival,
  '{{"@timestamp":"' || regexp_extract(raw, '"timestamp":"([^"]*)Z"', 1)
  || '.' || lpad(CAST(arrival * 7 % 1000 AS VARCHAR(4)), 3, '0') || 'Z"'
  || ',"service":"' || CASE WHEN arrival % 5 = 0 THEN 'origin-server' ELSE 'access-gateway' END
  || '","remote_addr":"' || regexp_extract(raw, '"client_ip":"([^"]*)"', 1)
  || '","http_x_session_token":"' || regexp_extract(raw, 'token=(tok-[0-9]+-[0-9]+)', 1)
  || '","token_logical_client_id":"lc' || lpad(CAST(arrival % 150 AS VARCHAR(4)), 3, '0')
  || '","json":' || raw || '}}' AS raw
FROM ({ACCESS_LOG}) b
"""

# Log records of API events: a browse event per view, a token event per event of any other type, typed values.
API_EVENTS = """
SELECT event_id AS arrival,
  '{"@timestamp":"' || replace(CAST(date_trunc('second', ts) AS VARCHAR(32)), ' ', 'T') || '.000Z"'
  || ',"event_source":"api","event_kind":"' || CASE WHEN event_type = 'view' THEN 'browse_content' ELSE 'token_issued' END
  || '","request_method":"' || CASE WHEN event_type = 'view' THEN 'GET' ELSE 'POST' END
  || '","request_uri":"' || CASE WHEN event_type = 'view' THEN '/api/browse/content/c' || CAST(user_id % 9 AS VARCHAR(4)) ELSE '/api/playback/start' END
  || '","query_string":"content_id=c' || CAST(user_id % 9 AS VARCHAR(4)) || '&label=&run_id=api%2D' || CAST(user_id % 5 AS VARCHAR(4)) || '+x'
  || '","status":200,"bytes_sent":0,"response_time_ms":0.5,"token_ttl_sec":1800,"token_valid":'
  || CASE WHEN event_type = 'view' THEN 'false' ELSE 'true' END
  || ',"token_dataset_label":"ds' || CAST(user_id % 2 AS VARCHAR(4))
  || '","cdn_token_id":"' || CASE WHEN event_type = 'view' THEN '' ELSE 'cdn_' || lpad(CAST(user_id AS VARCHAR(24)), 24, '0') END
  || '","client_ip":"-","remote_addr":"172.18.0.1","request_id":"api-' || CAST(event_id AS VARCHAR(20)) || '"}' AS raw
FROM events
"""

USERS = """
SELECT c_custkey AS id, lower(c_name) || '@test.com' AS email, c_name AS username, lower(c_mktsegment) AS subscription_plan,
  c_acctbal >= 0 AS is_active, TIMESTAMP '2024-01-01 00:00:00' + c_custkey * INTERVAL '1' DAY AS created_at FROM customer
"""

SESSIONS = """
SELECT o_orderkey AS id, o_custkey AS user_id, 'session_' || CAST(o_orderkey AS VARCHAR(20)) AS session_token,
  'refresh_' || CAST(o_orderkey AS VARCHAR(20)) AS refresh_token,
  o_orderstatus <> 'F' AS is_active, o_orderdate + INTERVAL '7' DAY AS expires_at, o_orderdate AS created_at, o_orderdate AS last_activity FROM orders
"""

WATCH_ACTIONS = """
SELECT o.o_custkey AS user_id, CAST(l.l_partkey % 50 AS BIGINT) AS content_id, 'session_' || CAST(l.l_orderkey AS VARCHAR(20)) AS session_token,
  CASE WHEN l.l_linenumber % 3 = 0 THEN ' ' WHEN l.l_linenumber % 3 = 1 THEN 'A' ELSE 'N' END AS label,
  '192.168.0.' || CAST(l.l_suppkey % 250 AS VARCHAR(8)) AS ip_address,
  CAST(l.l_quantity AS INT) AS watch_duration, CASE WHEN l.l_partkey % 97 = 0 THEN 0 ELSE 50 END AS total_duration,
  l.l_shipdate AS ts, l.l_orderkey AS seq1, l.l_linenumber AS seq2
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
"""

CONTENTS = """
SELECT CAST(p_partkey AS VARCHAR(20)) AS content_id, 'path_' || CAST(p_partkey AS VARCHAR(20)) AS hls_path,
  p_name AS title, 'About ' || p_name AS description, p_type AS genre_text, p_brand AS category,
  CASE WHEN p_size % 7 = 0 THEN NULL ELSE 1980 + p_size END AS year, p_size > 40 AS featured,
  CASE WHEN p_partkey % 10 = 0 THEN 'live' ELSE 'vod' END AS content_type,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'src_' || CAST(p_partkey AS VARCHAR(20)) END AS source_path,
  TIMESTAMP '2023-01-01 00:00:00' AS created_at, TIMESTAMP '2023-01-01 00:00:00' AS updated_at FROM part
"""

# Catalog writes: every line item rewrites its part; some are new or lack a title.
CATALOG_WRITES = """
SELECT l_orderkey * 10 + l_linenumber AS seq,
  CAST(CASE WHEN l_linenumber = 7 THEN l_partkey + 1000000000 ELSE l_partkey END AS VARCHAR(20)) AS content_id,
  CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE 'new_' || CAST(l_partkey AS VARCHAR(20)) END AS hls_path,
  CASE WHEN l_suppkey % 5 = 0 THEN ' ' ELSE ' Title ' || CAST(l_suppkey AS VARCHAR(20)) END AS title,
  'd' || CAST(l_orderkey % 3 AS VARCHAR(4)) AS description,
  CASE WHEN l_linenumber = 3 THEN '' ELSE CAST(1990 + l_suppkey % 30 AS VARCHAR(8)) END AS year,
  '' AS rating, 'Drama, ,Action' AS genre, '' AS category,
  CASE WHEN l_linenumber = 2 THEN 'LIVE' ELSE '' END AS content_type, l_tax > 0.04 AS featured, '' AS available_resolutions,
  CASE WHEN l_linenumber % 3 = 0 THEN 'up_' || CAST(l_orderkey AS VARCHAR(20)) ELSE '' END AS source_path,
  l_shipdate AS ts FROM lineitem
"""

AUDIT_LOGS = """
SELECT event_id AS id, user_id, CASE event_type WHEN 'signup' THEN 'register' WHEN 'view' THEN 'browse_content'
  WHEN 'purchase' THEN 'playback_start' WHEN 'click' THEN 'login_success' ELSE 'login_failed' END AS action,
  event_type <> 'error' AS success, props AS details, ts AS created_at FROM events
"""

FAVORITE_ACTIONS = """
SELECT event_id AS seq, user_id, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 16 AS content_id,
  CASE event_type WHEN 'click' THEN 'add' ELSE 'remove' END AS op, ts FROM events
"""

USER_ACTIONS = """
SELECT event_id AS seq, user_id + 1 AS user_id, ts,
  CASE event_type WHEN 'click' THEN 'login' WHEN 'error' THEN 'disable' ELSE 'enable' END AS kind
FROM events
"""

SESSION_ACTIONS = """
SELECT event_id AS seq, 'session_' || CAST(event_id * 3 AS VARCHAR(20)) AS session_token, ts,
  CASE event_type WHEN 'error' THEN 'end' ELSE 'activity' END AS kind FROM events
"""

# Block-list actions on addresses, tokens and referers that occur in the log.
BLACKLIST_ACTIONS = f"""
SELECT arrival AS seq,
  CASE CAST(arrival % 3 AS INT) WHEN 0 THEN 'ips' WHEN 1 THEN 'tokens' ELSE CASE WHEN arrival % 7 = 0 THEN 'agents' ELSE 'referers' END END AS type,
  CASE CAST(arrival % 3 AS INT) WHEN 0 THEN regexp_extract(raw, '"client_ip":"([^"]*)"', 1)
    WHEN 1 THEN regexp_extract(raw, 'token=(tok-[0-9]+-[0-9]+)', 1)
    ELSE regexp_extract(raw, '"http_referer":"([^"]*)"', 1) END AS value,
  CASE WHEN arrival % 4 = 1 THEN 'add' ELSE 'remove' END AS op
FROM ({ACCESS_LOG}) b
"""

# One run per user and day. Errors are not expected; runs without late types have an id that the log does not know.
RUN_MANIFEST = """
SELECT CASE WHEN max(CASE WHEN event_type <> 'error' THEN event_type END) > 'purchase' THEN 'run-' ELSE 'old-' END || CAST(user_id AS VARCHAR(20)) || '-' || CAST(day(ts) AS VARCHAR(8)) AS run_id,
  1 AS schema_version, CASE WHEN user_id % 4 = 0 THEN 'lab_20240101_x' ELSE 'tnsm_100lc_20240101_x' END AS dataset_prefix,
  CASE WHEN user_id % 5 = 0 THEN 'B1' ELSE 'A' || CAST(user_id % 7 + 1 AS VARCHAR(4)) END AS scenario_id,
  CASE WHEN user_id % 6 = 0 THEN 'M9' WHEN user_id % 6 = 1 THEN NULL ELSE 'M2' END AS attack_family,
  user_id - 3 AS seed, CASE WHEN user_id % 9 = 0 THEN 'paused' ELSE 'completed' END AS status,
  'lc' || lpad(CAST(user_id % 100 AS VARCHAR(8)), 3, '0') || CASE WHEN user_id % 8 = 0 THEN ',lc' || lpad(CAST(user_id % 100 AS VARCHAR(8)), 3, '0')
     WHEN user_id % 8 = 1 THEN ',x1' ELSE ',lc999' END AS clients_text,
  CAST(count(CASE WHEN event_type <> 'error' THEN 1 END) + user_id % 2 AS BIGINT) AS expected_request_count,
  CASE WHEN user_id % 11 = 0 THEN NULL ELSE '2024-02-' || lpad(CAST(day(ts) AS VARCHAR(8)), 2, '0') || 'T08:00:00Z' END AS scheduled_at,
  '2024-01-' || lpad(CAST(day(ts) AS VARCHAR(8)), 2, '0') || CASE CAST(user_id % 10 AS INT) WHEN 1 THEN ' 10:00:00Z' WHEN 2 THEN 'T10:00:00' WHEN 3 THEN 't10:00:00.25+09:00' ELSE 'T10:00:00z' END AS started_at,
  CASE CAST(user_id % 13 AS INT) WHEN 1 THEN '2023-02-29T10:00:00Z' WHEN 2 THEN '2024-02-29T10:00:60Z' WHEN 3 THEN '2024-01-02T24:00:00Z' WHEN 4 THEN '' ELSE '2024-01-31T23:59:59-00:30' END AS ended_at
FROM events
GROUP BY user_id, day(ts)
"""

# One logical client per customer, with deliberate collisions in some fields.
LOGICAL_CLIENTS = """
SELECT c_custkey AS logical_client_index,
  'lc' || lpad(CAST(CASE WHEN c_custkey % 211 = 0 THEN c_custkey - 1 ELSE c_custkey END AS VARCHAR(12)), 3, '0') AS logical_client_id,
  'pi' || lpad(CAST(c_custkey % 10 + 1 AS VARCHAR(4)), 2, '0') AS physical_host_id,
  '192.168.0.' || CAST(140 + c_custkey % 97 AS VARCHAR(8)) AS source_ip,
  'user' || CAST(c_custkey AS VARCHAR(12)) || '@test.com' AS account_email,
  'dev-lc' || CAST(CASE WHEN c_custkey % 307 = 0 THEN 1 ELSE c_custkey END AS VARCHAR(12)) AS device_id,
  'P' || CAST(c_custkey % 5 AS VARCHAR(4)) AS network_profile_id FROM customer
"""

# Playlists of each part: a master and up to two media playlists, some broken on purpose.
PLAYLISTS = """
WITH base AS (
  SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 0 THEN 'live_' ELSE 'video_' END || CAST(p_partkey AS VARCHAR(20)) AS content_id,
         p_size AS n, replace('#EXTM3U~#EXT-X-STREAM-INF:BANDWIDTH=2896000,CODECS="avc1,mp4a",RESOLUTION=1920x1080~1080p/playlist.m3u8~#EXT-X-STREAM-INF:BANDWIDTH=1596000~720p/playlist.m3u8?v=1~', '~', chr(10)) AS master
  FROM part),
media AS (
  SELECT k, content_id, '1080p' AS r, n FROM base WHERE k % 13 <> 0 AND k % 101 <> 0
  UNION ALL SELECT k, content_id, '720p' AS r, n FROM base WHERE k % 101 <> 0)
SELECT content_id, 'master.m3u8' AS path, master AS body FROM base WHERE k % 17 <> 0
UNION ALL
SELECT content_id, r || '/playlist.m3u8' AS path,
  '#EXTM3U' || chr(10) || '#EXT-X-TARGETDURATION:' || CASE WHEN k % 19 = 0 THEN 'x' ELSE CAST(k % 6 + 2 AS VARCHAR(4)) END || chr(10)
  || '#EXT-X-MEDIA-SEQUENCE:' || CAST(k % 1000 AS VARCHAR(8)) || chr(10)
  || CASE WHEN n % 9 = 0 THEN '' ELSE '#EXTINF:2.0,' || chr(10) || ' seg_' || CAST(k AS VARCHAR(20)) || '.ts ' || chr(10)
     || '#EXTINF:2.0,' || chr(10) || 'seg_' || CAST(k + n AS VARCHAR(20)) || '.ts?x=1' || chr(10) END
  || CASE WHEN k % 10 = 0 OR n = 1 THEN '' ELSE '#EXT-X-ENDLIST' || chr(10) END AS body
FROM media
"""

# The files present in the tree: the playlists and their segments, with some segments missing.
MEDIA_FILES = f"""
WITH segments AS (
  SELECT p_partkey AS k, p_partkey AS number FROM part
  UNION ALL SELECT p_partkey AS k, p_partkey + p_size AS number FROM part WHERE p_partkey % 23 <> 0),
named AS (
  SELECT CASE WHEN k % 10 = 0 THEN 'live_' ELSE 'video_' END || CAST(k AS VARCHAR(20)) AS content_id,
    '/seg_' || CAST(number AS VARCHAR(20)) || '.ts' AS name FROM segments)
SELECT content_id, path FROM ({PLAYLISTS}) a
UNION ALL SELECT content_id, '1080p' || name AS path FROM named
UNION ALL SELECT content_id, '720p' || name AS path FROM named
"""

# Playback token payloads of all events, the request they come with, and its flaws.
TOKEN_PAYLOADS = """
SELECT event_id, user_id, CAST(event_id % 12 AS INT) AS flaw,
  'video_' || CAST(user_id % 13 AS VARCHAR(8)) AS hls_path,
  CASE WHEN event_id % 2 = 0 THEN 'edge-kr' ELSE 'edge-us' END AS edge,
  1704067200 + event_id AS iat, 1704067200 + event_id + CASE WHEN event_id % 12 = 3 THEN 0 ELSE 100000000 END AS exp,
  'run-' || CAST(user_id AS VARCHAR(8)) AS rid, 'A1' AS scn,
  '192.168.0.' || CAST(user_id % 200 AS VARCHAR(8)) AS client_ip
FROM events
"""

SQL: dict[str, str] = {
    "access_log": ACCESS_LOG,
    "shipped_log": SHIPPED_LOG,
    "api_events": API_EVENTS,
    "users": USERS,
    "sessions": SESSIONS,
    "watch_actions": WATCH_ACTIONS,
    "contents_text": CONTENTS,
    "catalog_writes": CATALOG_WRITES,
    "audit_logs": AUDIT_LOGS,
    "favorite_actions": FAVORITE_ACTIONS,
    "user_actions": USER_ACTIONS,
    "session_actions": SESSION_ACTIONS,
    "blacklist_actions": BLACKLIST_ACTIONS,
    "run_manifest_text": RUN_MANIFEST,
    "logical_clients": LOGICAL_CLIENTS,
    "playlists": PLAYLISTS,
    "media_files": MEDIA_FILES,
    "token_payloads": TOKEN_PAYLOADS,
}


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def load(spark: SparkSession, sf_dir: str, name: str, tasks: int | None = None) -> DataFrame:
    """One derived input table; names of the given tables resolve to Parquet.

    Events are narrow, and the records made of them cost much more to parse than to move: they are dealt over
    ``tasks`` partitions.
    """
    for table in GIVEN:
        if table in SQL[name]:
            rows = dealt(spark.read.parquet(f"{sf_dir}/events.parquet"), tasks) if table == "events" else given(spark, sf_dir, table)
            rows.createOrReplaceTempView(table)
    return spark.sql(SQL[name])


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = load(spark, sf_dir, "contents_text")
    return text.withColumn("genre", F.split("genre_text", " ")).drop("genre_text")


def run_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = load(spark, sf_dir, "run_manifest_text")
    return text.select(
        "*",
        F.split("clients_text", ",").alias("logical_client_ids"),
        F.create_map(F.lit("k"), F.lit("v")).alias("parameters"),
        F.col("expected_request_count").alias("observed_request_count"),
    ).drop("clients_text")


def plain_times(df: DataFrame) -> DataFrame:
    """Instants as wall-clock UTC, the form the checks compare."""
    zoned = [n for n, t in df.dtypes if t == "timestamp"]
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in zoned}) if zoned else df
