"""Data-quality checks, playlists and the token audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import playlists, quality, tokens
from ..operators.graph_rows import graph_rows
from ..operators.normalize import normalize_requests
from . import inputs
from .oracle import norm_ctes, over, over_norm, over_rows, rows_ctes
from .registry import query

_UNIQUE = ["logical_client_id", "source_ip", "account_email", "device_id"]


@query(
    "unique_check",
    over(" UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS value, count(*) AS rows FROM logical_clients GROUP BY {c} HAVING count(*) > 1" for c in _UNIQUE), "logical_clients"),
)
def unique_check(spark, sf_dir):
    return quality.check_unique(inputs.load(spark, sf_dir, "logical_clients"), _UNIQUE)


_EXPECTED = "SELECT 'P' || CAST(n_nationkey AS VARCHAR(4)) AS value, CAST(20 AS BIGINT) AS rows FROM nation WHERE n_nationkey <= 5"


@query(
    "distribution_check",
    over(f"""SELECT coalesce(e.value, s.value) AS value, coalesce(e.rows, 0) AS expected, coalesce(s.n, 0) AS observed FROM ({_EXPECTED}) e
    FULL JOIN (SELECT network_profile_id AS value, count(*) AS n FROM logical_clients GROUP BY 1) s USING (value) WHERE coalesce(e.rows, 0) <> coalesce(s.n, 0)""", "logical_clients"),
)
def distribution_check(spark, sf_dir):
    inputs.given(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return quality.check_distribution(inputs.load(spark, sf_dir, "logical_clients"), "network_profile_id", spark.sql(_EXPECTED))


@query(
    "address_check",
    over("""SELECT DISTINCT source_ip AS ip, CASE WHEN source_ip IN ('192.168.0.140', '192.168.0.150') THEN 'reserved' ELSE 'unexpected' END AS problem
      FROM logical_clients WHERE CAST(split_part(source_ip, '.', 4) AS INT) NOT BETWEEN 151 AND 250
      UNION ALL SELECT '192.168.0.' || i, 'missing' FROM range(151, 251) r(i) WHERE '192.168.0.' || i NOT IN (SELECT source_ip FROM logical_clients)""", "logical_clients"),
)
def address_check(spark, sf_dir):
    return quality.check_addresses(inputs.load(spark, sf_dir, "logical_clients"), "source_ip", ["192.168.0.140", "192.168.0.150"])


_RULES = {
    "dataset_prefix": "NOT regexp_matches(dataset_prefix, '^tnsm_100lc_[0-9]{8}_.+$')",
    "scenario_id": "NOT regexp_matches(scenario_id, '^[NA][1-7]$')",
    "attack_family": "attack_family NOT IN ('M1', 'M2', 'M3', 'M4', 'M5')",
    "seed": "seed < 0",
    "status": "status NOT IN ('scheduled', 'running', 'completed', 'failed', 'cancelled')",
    "run_id": "length(run_id) < 8",
    "client_ids_unique": "len(list_distinct(string_split(clients_text, ','))) <> len(string_split(clients_text, ','))",
    "client_ids_pattern": "len([x for x in string_split(clients_text, ',') if NOT regexp_matches(x, '^lc[0-9]{3}$')]) > 0",
    **{
        t: f"NOT regexp_matches({t}, '{quality.DATE_TIME}') OR try_cast(left({t}, 10) AS DATE) IS NULL AND {t} IS NOT NULL"
        for t in quality.MANIFEST_TIMES
    },
}


@query(
    "manifest_check",
    over(" UNION ALL ".join(f"SELECT run_id, '{r}' AS rule FROM run_manifest_text WHERE {c}" for r, c in _RULES.items()), "run_manifest_text"),
)
def manifest_check(spark, sf_dir):
    return quality.check_manifest(inputs.run_manifest(spark, sf_dir))


@query(
    "manifest_reconcile",
    f"WITH {rows_ctes()}, manifest AS ({inputs.SQL['run_manifest_text']})" + """
    SELECT run_id, m.expected_request_count AS expected, coalesce(o.n, 0) AS observed, coalesce(o.sessions, 0) AS sessions,
      CASE WHEN m.expected_request_count IS NULL THEN 'unplanned' WHEN o.n IS NULL THEN 'missing' WHEN o.n < m.expected_request_count THEN 'short'
        WHEN o.n > m.expected_request_count THEN 'excess' ELSE 'match' END AS state
    FROM manifest m FULL JOIN (SELECT run_id, count(*) AS n, count(DISTINCT viewing_session_id) AS sessions FROM grows WHERE run_id <> '-' GROUP BY run_id) o USING (run_id)""",
)
def manifest_reconcile(spark, sf_dir):
    rows = graph_rows(inputs.load(spark, sf_dir, "access_log"), ["run_id", "viewing_session_id"])
    return quality.reconcile_manifest(inputs.run_manifest(spark, sf_dir), rows)


@query(
    "client_address_check",
    f"WITH {norm_ctes('shipped_log')}, logical_clients AS ({inputs.SQL['logical_clients']})" + """
    SELECT n.logical_client_id, n.client_ip, n.requests, c.source_ip FROM (
      SELECT logical_client_id, client_ip, count(*) AS requests FROM norm WHERE logical_client_id NOT IN ('', '-') GROUP BY ALL) n
    LEFT JOIN logical_clients c USING (logical_client_id) WHERE c.source_ip IS NULL OR c.source_ip <> n.client_ip""",
)
def client_address_check(spark, sf_dir):
    requests = normalize_requests(inputs.load(spark, sf_dir, "shipped_log"), ["logical_client_id", "client_ip"])
    return quality.check_client_addresses(requests, inputs.load(spark, sf_dir, "logical_clients"))


# The shipped log twice over for some records: what a shipper that retries delivers.
_DELIVERED = f"SELECT * FROM ({inputs.ACCESS_LOG}) a UNION ALL SELECT * FROM ({inputs.ACCESS_LOG}) b WHERE contains(raw, '/api/playback/start')"
inputs.SQL["delivered_log"] = _DELIVERED


@query(
    "duplicate_events",
    over_norm("SELECT request_log_id, count(*) AS rows FROM norm GROUP BY request_log_id HAVING count(*) > 1", "delivered_log"),
)
def duplicate_events(spark, sf_dir):
    return quality.duplicate_events(normalize_requests(inputs.load(spark, sf_dir, "delivered_log"), ["request_log_id"]))


@query(
    "missing_events",
    over_norm("""SELECT CAST(event_id AS VARCHAR) AS request_log_id FROM events WHERE CAST(event_id AS VARCHAR) NOT IN (
      SELECT request_log_id FROM norm WHERE status < 400)"""),
)
def missing_events(spark, sf_dir):
    requests = normalize_requests(inputs.load(spark, sf_dir, "access_log"), ["request_log_id", "status"])
    expected = inputs.given(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("request_log_id"))
    return quality.missing_events(requests.where("status < 400"), expected)


@query(
    "split_leakage",
    over_rows("""SELECT cdn_token_id, count(DISTINCT day(fold_ts) % 3) AS splits FROM grows WHERE cdn_token_id <> ''
      GROUP BY cdn_token_id HAVING count(DISTINCT day(fold_ts) % 3) > 1
      UNION ALL SELECT account_id, count(DISTINCT day(fold_ts) % 3) FROM grows WHERE account_id <> '-' GROUP BY account_id HAVING count(DISTINCT day(fold_ts) % 3) > 1"""),
)
def split_leakage(spark, sf_dir):
    rows = graph_rows(inputs.load(spark, sf_dir, "access_log"), ["cdn_token_id", "account_id"])
    rows = rows.withColumn("split", F.dayofmonth("fold_ts") % 3)
    tokens_ = quality.split_leakage(rows.where("cdn_token_id <> ''"), "cdn_token_id", "split")
    people = quality.split_leakage(rows.where("account_id <> '-'"), "account_id", "split")
    return tokens_.unionByName(people.withColumnRenamed("account_id", "cdn_token_id"))


@query("export_without_provenance", over_rows("SELECT arrival, request_kind, content_id, bytes_sent FROM grows"))
def export_without_provenance(spark, sf_dir):
    columns = ["request_kind", "content_id", "bytes_sent", "run_id", "scenario_id", "logical_client_id"]
    return quality.without_provenance(graph_rows(inputs.load(spark, sf_dir, "access_log"), columns)).drop("fold_ts")


@query(
    "set_difference",
    over("""SELECT content_id, 'left' AS side FROM (SELECT DISTINCT content_id FROM contents_text) a WHERE content_id NOT IN (SELECT content_id FROM catalog_writes)
      UNION ALL SELECT DISTINCT content_id, 'right' FROM catalog_writes WHERE content_id NOT IN (SELECT content_id FROM contents_text)""", "contents_text", "catalog_writes"),
)
def set_difference(spark, sf_dir):
    return quality.set_difference(inputs.load(spark, sf_dir, "contents_text"), inputs.load(spark, sf_dir, "catalog_writes"), "content_id")


# --- playlists -----------------------------------------------------------------------------

_MEDIA = """lines AS (SELECT content_id, path, split_part(path, '/', 1) AS rendition, [trim(x) for x in string_split(body, chr(10)) if trim(x) <> ''] AS l FROM playlists WHERE path <> 'master.m3u8'),
media AS (SELECT content_id, path, rendition, len([x for x in l if NOT starts_with(x, '#')]) AS segment_count,
  [x for x in l if NOT starts_with(x, '#')][1] AS first_segment, [x for x in l if NOT starts_with(x, '#')][-1] AS last_segment,
  TRY_CAST(split_part([x for x in l if starts_with(x, '#EXT-X-TARGETDURATION')][1], ':', 2) AS BIGINT) AS target_duration_sec,
  TRY_CAST(split_part([x for x in l if starts_with(x, '#EXT-X-MEDIA-SEQUENCE')][1], ':', 2) AS BIGINT) AS media_sequence,
  list_contains(l, '#EXT-X-ENDLIST') AS has_endlist FROM lines)"""


def _media_sql(select: str) -> str:
    return over("SELECT 1", "playlists", "media_files").replace(" SELECT 1", f", {_MEDIA} {select}")


@query("media_playlists", _media_sql("SELECT * FROM media"))
def media_playlists(spark, sf_dir):
    return playlists.media_playlists(inputs.load(spark, sf_dir, "playlists"))


@query(
    "master_variants",
    over("""SELECT content_id, v.uri, v.bandwidth, v.codecs, v.resolution FROM playlists p JOIN (
      SELECT '1080p/playlist.m3u8' AS uri, '2896000' AS bandwidth, 'avc1,mp4a' AS codecs, '1920x1080' AS resolution
      UNION ALL SELECT '720p/playlist.m3u8?v=1', '1596000', NULL, NULL) v ON contains(p.body, v.uri) WHERE p.path = 'master.m3u8'""", "playlists"),
)
def master_variants(spark, sf_dir):
    found = playlists.variants(inputs.load(spark, sf_dir, "playlists"))
    values = [F.col("attributes")[k].alias(k.lower()) for k in ("BANDWIDTH", "CODECS", "RESOLUTION")]
    return found.select("content_id", "uri", *values)


_ERRORS = """, contents AS (SELECT DISTINCT content_id FROM media_files), f AS (SELECT content_id || '/' || path AS p FROM media_files),
errors AS (
  SELECT content_id, 'missing master.m3u8' AS error FROM contents WHERE content_id NOT IN (SELECT content_id FROM playlists WHERE path = 'master.m3u8')
  UNION SELECT content_id, 'no media playlists' FROM contents WHERE content_id NOT IN (SELECT content_id FROM media)
  UNION SELECT content_id, 'missing master variant: ' || v FROM (SELECT content_id, unnest(['1080p/playlist.m3u8', '720p/playlist.m3u8']) AS v FROM playlists WHERE path = 'master.m3u8') x
    WHERE content_id || '/' || v NOT IN (SELECT p FROM f)
  UNION SELECT content_id, 'missing referenced first_segment: ' || content_id || '/' || rendition || '/' || first_segment FROM media
    WHERE first_segment IS NOT NULL AND content_id || '/' || rendition || '/' || split_part(first_segment, '?', 1) NOT IN (SELECT p FROM f)
  UNION SELECT content_id, 'missing referenced last_segment: ' || content_id || '/' || rendition || '/' || last_segment FROM media
    WHERE last_segment IS NOT NULL AND content_id || '/' || rendition || '/' || split_part(last_segment, '?', 1) NOT IN (SELECT p FROM f)),
items AS (SELECT content_id, CASE WHEN starts_with(content_id, 'live_') OR coalesce(m.open, false) THEN 'live' ELSE 'vod' END AS content_type,
  content_id IN (SELECT content_id FROM playlists WHERE path = 'master.m3u8') AS master_exists, coalesce(m.n, 0) AS playlists,
  concat_ws(',', CASE WHEN NOT coalesce(m.a, false) THEN '1080p' END, CASE WHEN NOT coalesce(m.b, false) THEN '720p' END) AS missing_renditions, coalesce(e.n, 0) AS errors
  FROM contents LEFT JOIN (SELECT content_id, count(*) AS n, bool_or(NOT has_endlist) AS open, bool_or(rendition = '1080p') AS a, bool_or(rendition = '720p') AS b
    FROM media GROUP BY content_id) m USING (content_id) LEFT JOIN (SELECT content_id, count(*) AS n FROM errors GROUP BY content_id) e USING (content_id))"""


def _inventory_sql(select: str) -> str:
    return _media_sql("SELECT 1").replace(") SELECT 1", f"){_ERRORS} {select}")


def _inventory_inputs(spark, sf_dir):
    return inputs.load(spark, sf_dir, "playlists"), inputs.load(spark, sf_dir, "media_files")


@query("playlist_errors", _inventory_sql("SELECT * FROM errors"))
def playlist_errors(spark, sf_dir):
    return playlists.reference_errors(*_inventory_inputs(spark, sf_dir))


@query("playlist_inventory", _inventory_sql("SELECT * FROM items"))
def playlist_inventory(spark, sf_dir):
    return playlists.inventory(*_inventory_inputs(spark, sf_dir))


@query(
    "inventory_summary",
    _inventory_sql("""SELECT contents, vod, live, contents_with_errors, contents_missing_renditions,
      vod >= 13 AND live >= 3 AND contents_with_errors = 0 AND contents_missing_renditions = 0 AS passed FROM (SELECT count(*) AS contents,
      count(*) FILTER (WHERE content_type = 'vod') AS vod, count(*) FILTER (WHERE content_type = 'live') AS live,
      count(*) FILTER (WHERE errors > 0) AS contents_with_errors, count(*) FILTER (WHERE missing_renditions <> '') AS contents_missing_renditions FROM items) t"""),
)
def inventory_summary(spark, sf_dir):
    return playlists.inventory_summary(playlists.inventory(*_inventory_inputs(spark, sf_dir)), 13, 3)


def _snapshots(spark, sf_dir):
    """The inventory, its live playlists as read, and a later state in which two in three have moved on."""
    bodies, files = _inventory_inputs(spark, sf_dir)
    items = playlists.inventory(bodies, files)
    live = playlists.live_playlists(playlists.media_playlists(bodies), items)
    number = F.col("media_sequence")
    later = live.where(number % 70 != 0).withColumns({
        "media_sequence": F.when(number % 3 == 0, number + 1).otherwise(number),
        "last_segment": F.when(number % 3 == 1, F.concat(F.lit("n"), "last_segment")).otherwise(F.col("last_segment")),
    })
    return items, live, later


_ADVANCE = """, live AS (SELECT content_id || '/' || path AS key, * FROM media WHERE content_id IN (SELECT content_id FROM items WHERE content_type = 'live')),
later AS (SELECT key, CASE WHEN media_sequence % 3 = 0 THEN media_sequence + 1 ELSE media_sequence END AS s,
  CASE WHEN media_sequence % 3 = 1 THEN 'n' || last_segment ELSE last_segment END AS g FROM live WHERE media_sequence % 70 <> 0),
checked AS (SELECT live.key, live.media_sequence AS before_sequence, live.last_segment AS before_last_segment, later.s AS after_sequence, later.g AS after_last_segment,
  coalesce(later.s > live.media_sequence, false) OR coalesce(later.g <> live.last_segment, false) AS advanced FROM live LEFT JOIN later USING (key))"""


@query("live_advance", _inventory_sql("SELECT 1").replace(") SELECT 1", f"){_ADVANCE} SELECT * FROM checked"))
def live_advance(spark, sf_dir):
    _, live, later = _snapshots(spark, sf_dir)
    return playlists.live_advance(live, later)


@query(
    "live_advance_summary",
    _inventory_sql("SELECT 1").replace(") SELECT 1", f"""){_ADVANCE} SELECT l.n AS live_contents, c.n AS playlists_checked, c.failed,
      l.n >= 3 AND c.n > 0 AND c.failed = 0 AS passed FROM (SELECT count(*) AS n FROM items WHERE content_type = 'live') l,
      (SELECT count(*) AS n, count(*) FILTER (WHERE NOT advanced) AS failed FROM checked) c"""),
)
def live_advance_summary(spark, sf_dir):
    items, live, later = _snapshots(spark, sf_dir)
    return playlists.live_advance_summary(playlists.live_advance(live, later), items, 3)


@query(
    "catalog_media_difference",
    over("""SELECT DISTINCT content_id AS path, 'media' AS side FROM media_files WHERE content_id NOT IN (SELECT 'video_' || content_id FROM contents_text)
      UNION ALL SELECT DISTINCT 'video_' || content_id, 'catalog' FROM contents_text WHERE 'video_' || content_id NOT IN (SELECT content_id FROM media_files)""", "contents_text", "media_files"),
)
def catalog_media_difference(spark, sf_dir):
    contents = inputs.contents(spark, sf_dir).withColumn("hls_path", F.concat(F.lit("video_"), "content_id"))
    return playlists.catalog_difference(contents, inputs.load(spark, sf_dir, "media_files"))


# --- token audit ---------------------------------------------------------------------------

TEST_SECRET = "test-secret"
AUDIT_TIME = 1_750_000_000

_PAYLOAD = """'{"uid":"' || CAST(user_id AS VARCHAR(20)) || '","sid":"s' || CAST(event_id AS VARCHAR(20)) || '","cid":"' || hls_path || '","path":"' || hls_path
  || '","edge":"' || edge || '","iat":' || CAST(iat AS VARCHAR(20)) || ',"exp":' || CAST(exp AS VARCHAR(20)) || ',"ip_bind":'
  || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || ',"client_ip":"' || client_ip || '","rid":"' || rid || '","scn":"' || scn || '","lbl":"","dsl":"ds","np":"P1"}'"""
_SIGNED = """'uid=' || CAST(user_id AS VARCHAR(20)) || '&sid=s' || CAST(event_id AS VARCHAR(20)) || '&cid=' || hls_path || '&path=' || hls_path || '&edge=' || edge
  || '&exp=' || CAST(exp AS VARCHAR(20)) || '&rid=' || rid || '&scn=' || scn || '&lbl=&dsl=ds&np=P1'"""
_AUDIT = f"""WITH t AS ({inputs.SQL['token_payloads']}) SELECT event_id, flaw NOT IN (0, 1, 2, 3, 4, 6, 8, 9) AS valid,
  CASE flaw WHEN 0 THEN 'missing_token_or_signature' WHEN 1 THEN 'invalid_token_encoding' WHEN 2 THEN 'invalid_token_encoding' WHEN 3 THEN 'token_expired'
    WHEN 4 THEN 'invalid_signature' WHEN 6 THEN 'edge_mismatch' WHEN 8 THEN 'ip_mismatch' WHEN 9 THEN 'content_path_mismatch' END AS reason,
  CASE WHEN flaw NOT IN (0, 1, 2, 3, 4, 6, 8, 9) THEN CAST(user_id AS VARCHAR) END AS token_user_id,
  CASE WHEN flaw NOT IN (0, 1, 2, 3, 4, 6, 8, 9) THEN exp - iat END AS token_ttl_sec,
  CASE WHEN flaw NOT IN (0, 1, 2, 3, 4, 6, 8, 9) THEN greatest(exp - {AUDIT_TIME}, 0) END AS token_ttl_remaining_sec,
  CASE WHEN flaw NOT IN (0, 1, 2, 3, 4, 6, 8, 9) THEN make_timestamp(exp * 1000000) END AS token_expires,
  CASE WHEN flaw NOT IN (0, 1, 2, 3, 4, 6, 8, 9) THEN rid END AS token_run_id,
  CASE WHEN flaw NOT IN (0, 1, 2, 3, 4, 6, 8, 9) THEN 'ds' END AS token_dataset_label FROM t"""


def token_requests(spark, sf_dir):
    """Signed tokens, each with the flaw its number names."""
    rows = inputs.load(spark, sf_dir, "token_payloads")
    payload, signed = F.expr(_PAYLOAD), F.expr(_SIGNED)
    token = F.translate(F.base64(F.encode(payload, "UTF-8")), "+/=\r\n", "-_")
    flaw = F.col("flaw")
    return rows.select(
        "event_id",
        F.when(flaw == 0, "").when(flaw == 1, "%%%").when(flaw == 2, "bm90IGpzb24").otherwise(token).alias("token"),
        F.when(flaw == 4, "00").otherwise(tokens.hmac_sha256(TEST_SECRET, signed)).alias("sig"),
        F.when(flaw == 6, "edge-sg").otherwise(F.col("edge")).alias("edge_id"),
        F.when(flaw == 9, "/hls/other/a.ts").otherwise(F.concat(F.lit("/hls/"), "hls_path", F.lit("/720p/a.ts?token=x"))).alias("request_uri"),
        F.when(flaw == 8, "10.0.0.9").otherwise(F.concat(F.lit("::ffff:"), "client_ip", F.lit(", 10.0.0.1"))).alias("client_ip"),
    )


@query("token_audit", _AUDIT)
def token_audit(spark, sf_dir):
    audited = tokens.audit_tokens(token_requests(spark, sf_dir), TEST_SECRET, AUDIT_TIME)
    return audited.select(
        "event_id", "valid", "reason", "token_user_id", "token_ttl_sec", "token_ttl_remaining_sec", "token_expires",
        "token_run_id", "token_dataset_label",
    )
