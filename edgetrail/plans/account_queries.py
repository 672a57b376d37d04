"""Users, sessions, history, favourites and catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.values import parse_flag, parse_positive_int
from ..operators import accounts, catalog
from . import inputs
from .oracle import over
from .registry import query

_NOW = "(SELECT max(last_activity) FROM sessions)"
_ACTIVE = f"is_active AND expires_at > {_NOW}"


def _tables(spark, sf_dir):
    users, sessions = (inputs.load(spark, sf_dir, n) for n in ("users", "sessions"))
    return users, sessions, inputs.given(spark, sf_dir, "orders").agg(F.max("o_orderdate")).first()[0]


@query("active_sessions", over(f"SELECT * FROM sessions WHERE {_ACTIVE}", "sessions"))
def active_sessions(spark, sf_dir):
    _, sessions, now = _tables(spark, sf_dir)
    return accounts.active_sessions(sessions, now)


@query(
    "sessions_with_users",
    over("SELECT s.*, email, username FROM sessions s JOIN users u ON s.user_id = u.id", "sessions", "users"),
)
def sessions_with_users(spark, sf_dir):
    users, sessions, now = _tables(spark, sf_dir)
    return accounts.sessions_with_users(sessions, users, now, active_only=False)


@query(
    "sessions_page",
    over(f"""SELECT s.*, email, username FROM sessions s JOIN users u ON s.user_id = u.id WHERE s.{_ACTIVE}
    ORDER BY last_activity DESC, s.id DESC LIMIT 100 OFFSET 5""", "sessions", "users"),
)
def sessions_page(spark, sf_dir):
    users, sessions, now = _tables(spark, sf_dir)
    found = accounts.sessions_with_users(sessions, users, now)
    return accounts.page(found, [F.desc("last_activity"), F.desc("id")], 100, 5)


_LOOKUPS = "SELECT 'session_' || CAST(l_orderkey + l_linenumber % 3 AS VARCHAR(20)) AS session_token, l_orderkey AS request FROM lineitem"


@query(
    "resolve_sessions",
    over(f"""SELECT r.request, r.session_token, s.user_id, u.email, u.subscription_plan FROM ({_LOOKUPS}) r
      LEFT JOIN (SELECT * FROM sessions WHERE {_ACTIVE}) s USING (session_token) LEFT JOIN users u ON u.id = s.user_id""", "sessions", "users"),
)
def resolve_sessions(spark, sf_dir):
    users, sessions, now = _tables(spark, sf_dir)
    inputs.given(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    found = accounts.resolved_requests(spark.sql(_LOOKUPS), sessions, users, now)
    return found.select("request", "session_token", "user_id", "email", "subscription_plan")


@query(
    "latest_session",
    over(f"""SELECT u.id AS user_id, coalesce(s.session_token, 'sess_' || substr(sha256(CAST(u.id AS VARCHAR)), 1, 32)) AS session_token,
      s.session_token IS NULL AS generated FROM users u LEFT JOIN (
        SELECT user_id, last(session_token ORDER BY last_activity, id) AS session_token FROM sessions WHERE {_ACTIVE} GROUP BY user_id) s
      ON s.user_id = u.id""", "sessions", "users"),
)
def latest_session(spark, sf_dir):
    users, sessions, now = _tables(spark, sf_dir)
    return accounts.latest_active_session(users, sessions, now)


@query(
    "newest_sessions",
    over("""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rank FROM sessions) x
    WHERE rank <= 10""", "sessions"),
)
def newest_sessions(spark, sf_dir):
    return accounts.newest_per_user(inputs.load(spark, sf_dir, "sessions"), "user_id", ["created_at", "id"], 10)


@query(
    "newest_audit_rows",
    over("""SELECT user_id, action, success, created_at, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rank FROM audit_logs) x WHERE rank <= 20""", "audit_logs"),
)
def newest_audit_rows(spark, sf_dir):
    newest = accounts.newest_per_user(inputs.load(spark, sf_dir, "audit_logs"), "user_id", ["created_at", "id"], 20)
    return newest.select("user_id", "action", "success", "created_at", "rank")


@query(
    "account_dashboard",
    over("""SELECT 'total_users' AS metric, '' AS key, count(*) AS value FROM users WHERE is_active
      UNION ALL SELECT 'active_sessions', '', count(*) FROM sessions WHERE is_active AND expires_at > (SELECT max(created_at) FROM audit_logs)
      UNION ALL SELECT 'recent_logins_24h', '', count(*) FROM audit_logs WHERE action = 'login_success'
        AND created_at > (SELECT max(created_at) FROM audit_logs) - INTERVAL 24 HOUR
      UNION ALL SELECT 'subscription_distribution', subscription_plan, count(*) FROM users WHERE is_active GROUP BY subscription_plan""",
      "users", "sessions", "audit_logs"),
)
def account_dashboard(spark, sf_dir):
    users, sessions, _ = _tables(spark, sf_dir)
    now = inputs.given(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    return accounts.account_dashboard(users, sessions, inputs.load(spark, sf_dir, "audit_logs"), now)


@query(
    "users_page",
    over("""SELECT id, email, username, is_active, created_at, (SELECT count(*) FROM users) AS total FROM users
    ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 10""", "users"),
)
def users_page(spark, sf_dir):
    users, _, _ = _tables(spark, sf_dir)
    rows, total = accounts.users_page(users, 50, 10)
    n = total.first()["total"]
    return rows.select("id", "email", "username", "is_active", "created_at", F.lit(n).alias("total"))


_HISTORY = """SELECT user_id, content_id, first(session_token ORDER BY ts, seq1, seq2) AS session_token,
  last(coalesce(nullif(trim(label), ''), 'normal') ORDER BY ts, seq1, seq2) AS label,
  last(watch_duration ORDER BY ts, seq1, seq2) AS watch_duration, last(total_duration ORDER BY ts, seq1, seq2) AS total_duration,
  last(round(watch_duration::DOUBLE / nullif(total_duration, 0) * 100, 2) ORDER BY ts, seq1, seq2) AS progress_percent,
  last(watch_duration::DOUBLE / nullif(total_duration, 0) * 100 >= 90 ORDER BY ts, seq1, seq2) AS completed,
  last(ip_address ORDER BY ts, seq1, seq2) AS ip_address, min(ts) AS created_at, max(ts) AS updated_at
  FROM watch_actions GROUP BY user_id, content_id"""


@query("watch_history", over(_HISTORY, "watch_actions"))
def watch_history(spark, sf_dir):
    return accounts.watch_history(inputs.load(spark, sf_dir, "watch_actions"))


@query("user_history", over(f"SELECT * FROM ({_HISTORY}) h WHERE user_id = 7 ORDER BY updated_at DESC, content_id LIMIT 20", "watch_actions"))
def user_history(spark, sf_dir):
    history = accounts.watch_history(inputs.load(spark, sf_dir, "watch_actions"))
    return accounts.user_history(history, 7)


_FAVORITES = """SELECT a.user_id, a.content_id, first(a.ts ORDER BY a.ts, a.seq) AS created_at FROM favorite_actions a
  WHERE a.op = 'add' AND NOT EXISTS (SELECT 1 FROM favorite_actions r WHERE r.op = 'remove' AND r.user_id = a.user_id
    AND r.content_id = a.content_id AND (r.ts, r.seq) > (a.ts, a.seq)) GROUP BY a.user_id, a.content_id"""


@query("favorites", over(_FAVORITES, "favorite_actions"))
def favorites(spark, sf_dir):
    return accounts.favorites(inputs.load(spark, sf_dir, "favorite_actions"))


@query("user_favorites", over(f"SELECT * FROM ({_FAVORITES}) f WHERE user_id = 7", "favorite_actions"))
def user_favorites(spark, sf_dir):
    return accounts.user_favorites(accounts.favorites(inputs.load(spark, sf_dir, "favorite_actions")), 7)


@query("user_profile", over("SELECT id, email, username, subscription_plan, created_at FROM users WHERE id = 7", "users"))
def user_profile(spark, sf_dir):
    return accounts.profile(inputs.load(spark, sf_dir, "users"), 7)


@query("user_sessions", over("SELECT * FROM sessions WHERE is_active AND expires_at > TIMESTAMP '1995-01-01' AND user_id = 7", "sessions"))
def user_sessions(spark, sf_dir):
    from datetime import datetime

    return accounts.user_sessions(inputs.load(spark, sf_dir, "sessions"), 7, datetime(1995, 1, 1))


@query(
    "user_state",
    over("""SELECT u.id, u.email, u.username, u.subscription_plan, coalesce(a.state, u.is_active) AS is_active, u.created_at, a.last_login
      FROM users u LEFT JOIN (SELECT user_id, last(kind = 'enable' ORDER BY ts, seq) FILTER (WHERE kind IN ('enable', 'disable')) AS state,
        max(ts) FILTER (WHERE kind = 'login') AS last_login FROM user_actions GROUP BY user_id) a ON a.user_id = u.id""", "users", "user_actions"),
)
def user_state(spark, sf_dir):
    return accounts.apply_user_actions(inputs.load(spark, sf_dir, "users"), inputs.load(spark, sf_dir, "user_actions"))


@query(
    "session_state",
    over("""SELECT s.id, s.user_id, s.session_token, s.refresh_token, s.is_active AND NOT coalesce(a.ended, false) AS is_active, s.expires_at, s.created_at,
      greatest(s.last_activity, a.active_at) AS last_activity FROM sessions s LEFT JOIN (SELECT session_token, bool_or(kind = 'end') AS ended,
        max(ts) FILTER (WHERE kind = 'activity') AS active_at FROM session_actions GROUP BY session_token) a USING (session_token)""", "sessions", "session_actions"),
)
def session_state(spark, sf_dir):
    return accounts.apply_session_actions(inputs.load(spark, sf_dir, "sessions"), inputs.load(spark, sf_dir, "session_actions"))


# --- catalog -------------------------------------------------------------------------------

_CONTENT_COLUMNS = "content_id, hls_path, title, description, genre_text AS genre, category, year, featured, content_type"
_ORDER = "ORDER BY featured DESC NULLS FIRST, year DESC NULLS FIRST, title ASC NULLS LAST, content_id"


def _shown(df):
    columns = ["content_id", "hls_path", "title", "description", "category", "year", "featured", "content_type"]
    return df.select(*columns, F.array_join("genre", " ").alias("genre"))


@query("catalog_list", over(f"SELECT {_CONTENT_COLUMNS} FROM contents_text", "contents_text"))
def catalog_list(spark, sf_dir):
    return _shown(catalog.list_contents(inputs.contents(spark, sf_dir)))


@query("catalog_recommended", over(f"SELECT {_CONTENT_COLUMNS} FROM contents_text WHERE content_type = 'vod' {_ORDER} LIMIT 4", "contents_text"))
def catalog_recommended(spark, sf_dir):
    return _shown(catalog.recommended(inputs.contents(spark, sf_dir)))


@query("catalog_trending", over(f"SELECT {_CONTENT_COLUMNS} FROM contents_text {_ORDER} LIMIT 10", "contents_text"))
def catalog_trending(spark, sf_dir):
    return _shown(catalog.trending(inputs.contents(spark, sf_dir)))


@query(
    "catalog_by_genre",
    over(f"SELECT {_CONTENT_COLUMNS} FROM contents_text WHERE list_contains(string_split(lower(genre_text), ' '), (SELECT lower(string_split(min(genre_text), ' ')[1]) FROM contents_text))", "contents_text"),
)
def catalog_by_genre(spark, sf_dir):
    contents = inputs.contents(spark, sf_dir)
    genre = contents.agg(F.min(F.array_join("genre", " "))).first()[0].split(" ")[0]
    return _shown(catalog.by_genre(contents, genre.upper()))


@query(
    "catalog_search",
    over(f"""SELECT {_CONTENT_COLUMNS} FROM contents_text WHERE content_id ILIKE '%_1%' OR title ILIKE '%_1%' OR description ILIKE '%_1%'
    OR category ILIKE '%_1%' OR genre_text ILIKE '%_1%'""", "contents_text"),
)
def catalog_search(spark, sf_dir):
    return _shown(catalog.search_contents(inputs.contents(spark, sf_dir), " _1 "))


@query(
    "catalog_sections",
    over(f"""SELECT CASE WHEN content_type = 'live' THEN '라이브' ELSE '콘텐츠' END AS section, count(*) AS contents,
    first(content_id {_ORDER}) AS first_content_id FROM contents_text GROUP BY 1""", "contents_text"),
)
def catalog_sections(spark, sf_dir):
    return catalog.catalog_sections(inputs.contents(spark, sf_dir))


@query("catalog_featured", over(f"SELECT {_CONTENT_COLUMNS} FROM contents_text ORDER BY coalesce(featured, false) DESC, {_ORDER[9:]} LIMIT 1", "contents_text"))
def catalog_featured(spark, sf_dir):
    return _shown(catalog.featured_content(inputs.contents(spark, sf_dir)))


@query(
    "catalog_upsert",
    over("""SELECT content_id, last(hls_path ORDER BY seq) AS hls_path, last(title ORDER BY seq) AS title, last(description ORDER BY seq) AS description,
      last(genre ORDER BY seq) AS genre, last(category ORDER BY seq) AS category, last(year ORDER BY seq) AS year, last(featured ORDER BY seq) AS featured,
      last(content_type ORDER BY seq) AS content_type, last(source_path ORDER BY seq) FILTER (WHERE source_path IS NOT NULL) AS source_path,
      first(written ORDER BY seq) AS created_at, last(written ORDER BY seq) AS updated_at FROM (
        SELECT CAST(-1 AS BIGINT) AS seq, content_id, hls_path, title, description, genre_text AS genre, category, year, featured, content_type, source_path, created_at AS written FROM contents_text
        UNION ALL SELECT seq, trim(content_id), trim(CASE WHEN hls_path <> '' THEN hls_path ELSE content_id END), trim(title), trim(description),
          'Drama Action', '콘텐츠', TRY_CAST(year AS INT), featured, lower(CASE WHEN content_type <> '' THEN content_type ELSE 'vod' END), nullif(source_path, ''), ts
        FROM catalog_writes WHERE trim(title) <> '') u GROUP BY content_id""", "contents_text", "catalog_writes"),
)
def catalog_upsert(spark, sf_dir):
    old = inputs.contents(spark, sf_dir)
    new = catalog.normalize_payload(inputs.load(spark, sf_dir, "catalog_writes"))
    state = catalog.upsert_contents(old, new)
    return state.withColumn("genre", F.array_join("genre", " "))


_DELETED = "SELECT CAST(s_suppkey * 3 AS VARCHAR(20)) AS content_id FROM supplier"


@query(
    "catalog_delete",
    over(f"""SELECT 'contents' AS source, content_id, count(*) AS n FROM contents_text WHERE content_id NOT IN (SELECT content_id FROM ({_DELETED}) x) GROUP BY content_id
      UNION ALL SELECT 'favorites', CAST(content_id AS VARCHAR), count(*) FROM favorite_actions
        WHERE CAST(content_id AS VARCHAR) NOT IN (SELECT content_id FROM ({_DELETED}) x JOIN contents_text USING (content_id)) GROUP BY content_id
      UNION ALL SELECT 'history', CAST(content_id AS VARCHAR), count(*) FROM watch_actions
        WHERE CAST(content_id AS VARCHAR) NOT IN (SELECT content_id FROM ({_DELETED}) x JOIN contents_text USING (content_id)) GROUP BY content_id""",
      "contents_text", "favorite_actions", "watch_actions"),
)
def catalog_delete(spark, sf_dir):
    inputs.given(spark, sf_dir, "supplier").createOrReplaceTempView("supplier")
    as_text = F.col("content_id").cast("string")
    favs, history = (inputs.load(spark, sf_dir, n).withColumn("content_id", as_text) for n in ("favorite_actions", "watch_actions"))
    left = catalog.delete_contents(inputs.contents(spark, sf_dir), favs, history, spark.sql(_DELETED))
    out = None
    for name, table in zip(("contents", "favorites", "history"), left, strict=True):
        part = table.groupBy("content_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "content_id", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "text_functions",
    """SELECT p_partkey, left(trim(regexp_replace(lower(trim(p_name || ' - ' || p_brand)), '[^a-z0-9가-힣]+', '_', 'g'), '_'), 60) AS slug,
      upper(left(regexp_replace(trim(p_type || '/' || p_brand), '[^a-zA-Z0-9_-]', '', 'g'), 12)) AS tag,
      array_to_string([trim(x) for x in string_split(p_type || ', ,' || p_brand, ',') if trim(x) <> ''], '|') AS items,
      concat_ws(' ', CASE WHEN greatest(p_partkey * 7, 1) // 3600 > 0 THEN CAST(greatest(p_partkey * 7, 1) // 3600 AS VARCHAR) || '시간' END,
        CASE WHEN greatest(p_partkey * 7, 1) >= 60 THEN CAST(greatest(p_partkey * 7, 1) % 3600 // 60 AS VARCHAR) || '분' END, CAST(greatest(p_partkey * 7, 1) % 60 AS VARCHAR) || '초') AS duration,
      CASE CAST(p_size % 3 AS INT) WHEN 0 THEN '1080p,720p' WHEN 1 THEN '720p' ELSE '1080p,720p' END AS resolutions,
      p_size % 2 = 0 AS flag, p_size AS number FROM part""",
)
def text_functions(spark, sf_dir):
    part = inputs.given(spark, sf_dir, "part")
    size = F.col("p_size")
    wanted = F.when(size % 3 == 0, F.array(F.lit("720p"), F.lit("x"), F.lit("1080p"))).when(
        size % 3 == 1, F.array(F.lit("720p"))
    ).otherwise(F.array(F.lit("4k")))
    return part.select(
        "p_partkey",
        text.slugify(F.concat_ws(" - ", "p_name", "p_brand")).alias("slug"),
        text.sanitize_tag(F.concat_ws("/", "p_type", "p_brand"), 12, "upper").alias("tag"),
        F.array_join(text.split_list(F.concat_ws(", ,", "p_type", "p_brand")), "|").alias("items"),
        text.duration_label(F.col("p_partkey") * 7).alias("duration"),
        F.array_join(text.resolutions(wanted), ",").alias("resolutions"),
        parse_flag(F.when(size % 2 == 0, " Yes ").otherwise("off")).alias("flag"),
        parse_positive_int(F.concat(F.lit(" "), size.cast("string"), F.lit("px"))).alias("number"),
    )
