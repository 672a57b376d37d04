"""Reports over normalized requests and graph rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .joins import join_on_summary

FANOUT_INPUTS = (
    "viewing_session_id", "cdn_token_id", "account_id", "content_id", "client_ip", "referrer_domain",
)


def newest(df: DataFrame, column: str) -> datetime:
    """Newest time of a column: the ``as_of`` of reports over a finished log."""
    return df.agg(F.max(column)).first()[0]


def time_range(df: DataFrame, column: str, as_of: datetime, hours: float) -> DataFrame:
    """Rows of the hours up to ``as_of``, both ends included."""
    end = F.lit(as_of)
    start = end - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600.0))
    return df.where((F.col(column) >= start) & (F.col(column) <= end))


_FANOUT_KINDS = ("account", "content", "ip", "referrer")


# --- token fan-out -------------------------------------------------------------------------


def _session_pairs(rows: DataFrame) -> DataFrame:
    """Distinct (session, kind, value) of tokens, accounts, contents, addresses and referrers.

    The sessions' accounts, contents, addresses and referrers are reduced to distinct pairs
    before the join, so no product of the four legs is formed.
    """
    legs = {
        "token": "if(cdn_token_id = '', NULL, cdn_token_id)",
        "account": "if(account_id IN ('', '-'), NULL, account_id)",
        "content": "if(content_id = '', NULL, content_id)",
        "ip": "if(client_ip IN ('', '-'), NULL, client_ip)",
        "referrer": "referrer_domain",
    }
    items = [
        F.when(F.expr(e).isNotNull(), F.struct(F.lit(k).alias("kind"), F.expr(e).alias("value")))
        for k, e in legs.items()
    ]
    return rows.select(
        "viewing_session_id", F.inline(F.array(*items))
    ).where("value IS NOT NULL").distinct()


def _first_values(legs: DataFrame, limits: dict[str, int]) -> DataFrame:
    """At most ``limit + 1`` distinct values of each kind in ``limits``, per session.

    That many decide whether a union of sessions has more than ``limit``.  Spark cuts the groups
    before and after the shuffle, so a session with very many addresses costs three rows per task.
    """
    kept = legs.where(F.col("kind").isin(list(limits)))
    place = F.row_number().over(Window.partitionBy("viewing_session_id", "kind").orderBy("value"))
    at_most = max(limits.values()) + 1
    return kept.withColumn("_place", place).where(F.col("_place") <= at_most).drop("_place")


def _flagged_sessions(rows: DataFrame, min_ip: int, min_referrer: int) -> tuple[DataFrame, DataFrame]:
    """(token, session, sessions) of the flagged tokens, ``sessions`` being how many the token has, and all legs.

    The distinct pairs are written once.  Flags are decided on a few values per session, so no
    token meets all members of its sessions before it is known to be flagged.
    """
    pairs = materialize(_session_pairs(rows), "session-pairs", "kind")
    legs = pairs.where("kind <> 'token'").select("viewing_session_id", "kind", "value")
    tokens = pairs.where("kind = 'token'").select("viewing_session_id", F.col("value").alias("token"))
    few = tokens.join(_first_values(legs, {"ip": min_ip, "referrer": min_referrer}), "viewing_session_id", "left")
    counts = _fanout_counts(few.select("token", "kind", "value").distinct(), "token")
    flagged = counts.where((F.col("ip_count") > min_ip) | (F.col("referrer_count") > min_referrer)).select("token")
    seen = tokens.groupBy("token").agg(F.count("*").alias("sessions")).join(flagged, "token", "left_semi")
    return materialize(join_on_summary(tokens, seen, ["token"], "sessions"), "flagged-sessions"), legs


def _fanout_counts(members: DataFrame, key: str) -> DataFrame:
    counts = [F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in _FANOUT_KINDS]
    return members.groupBy(key).agg(*counts)


def _members(flagged: DataFrame, legs: DataFrame) -> DataFrame:
    """Distinct (token, kind, value) reached through the tokens' sessions."""
    return flagged.join(legs, "viewing_session_id").select("token", "kind", "value").distinct()


def token_fanout(rows: DataFrame, min_ip: int = 2, min_referrer: int = 1) -> DataFrame:
    """Tokens used from more than ``min_ip`` addresses or ``min_referrer`` referrers, with exact counts.

    A flagged token of one session has that session's counts, so a session with many tokens and
    many members costs one row per token.  Only flagged tokens of several sessions unite members.
    """
    flagged, legs = _flagged_sessions(rows, min_ip, min_referrer)
    single = flagged.where("sessions = 1").join(_fanout_counts(legs, "viewing_session_id"), "viewing_session_id")
    united = _fanout_counts(_members(flagged.where("sessions > 1"), legs), "token")
    columns = ["token", *[f"{k}_count" for k in _FANOUT_KINDS]]
    return single.select(*columns).unionByName(united.select(*columns))


def token_fanout_members(rows: DataFrame, min_ip: int = 2, min_referrer: int = 1) -> DataFrame:
    """The accounts, contents, addresses and referrers of the flagged tokens, one per row.

    One row per member instead of one list per token: a token shared by very many clients
    never has to fit into one row.  Only flagged tokens meet the members of their sessions.
    """
    return _members(*_flagged_sessions(rows, min_ip, min_referrer))


def suspicious_sessions(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Sessions that used a flagged token, with their addresses: all pairs, or with ``limit`` the first ones."""
    flagged, legs = _flagged_sessions(rows, 2, 1)
    pairs = legs.where("kind = 'ip'").select("viewing_session_id", F.col("value").alias("client_ip"))
    found = pairs.join(flagged.select("viewing_session_id").distinct(), "viewing_session_id", "left_semi")
    return found if limit is None else found.orderBy("viewing_session_id", "client_ip").limit(limit)


# --- traffic -------------------------------------------------------------------------------


def traffic_totals(requests: DataFrame, as_of: datetime, hours: float = 1.0) -> DataFrame:
    """Requests, 403 answers and block rate of the last hour, as one row."""
    recent = time_range(requests, "event_ts", as_of, hours)
    totals = recent.agg(
        F.count("remote_addr").alias("total"), F.count_if(F.col("status") == 403).alias("blocked")
    )
    return block_rate(totals)


def block_rate(totals: DataFrame) -> DataFrame:
    """Adds allowed requests and the blocked share in percent, 0 without requests."""
    rate = F.when(F.col("total") > 0, F.round(F.col("blocked") * 100.0 / F.col("total"), 2)).otherwise(0.0)
    return totals.withColumns({"allowed": F.col("total") - F.col("blocked"), "block_rate": rate})


def top_addresses(
    requests: DataFrame, as_of: datetime, hours: float = 1.0, limit: int = 10, blocked_only: bool = False
) -> DataFrame:
    """Addresses with most requests; ``blocked_only`` counts 403 answers alone."""
    recent = time_range(requests, "event_ts", as_of, hours)
    if blocked_only:
        recent = recent.where(F.col("status") == 403)
    counts = recent.groupBy("remote_addr").agg(F.count("*").alias("requests"))
    return counts.orderBy(F.desc("requests"), "remote_addr").limit(limit)


def requests_over_time(requests: DataFrame, bucket: str = "1 hour") -> DataFrame:
    window = F.window("event_ts", bucket)
    return requests.groupBy(window.alias("w")).agg(F.count("*").alias("requests")).select(
        F.col("w.start").alias("bucket_start"), "requests"
    )


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Row counts per value of several columns, from one pass: (dimension, value, requests)."""
    items = [F.struct(F.lit(n).alias("dimension"), F.col(n).cast("string").alias("value")) for n in columns]
    long = df.select(F.inline(F.array(*items)))
    return long.groupBy("dimension", "value").agg(F.count("*").alias("requests"))


def search_filters(
    requests: DataFrame,
    agent_prefix: str | None = None,
    client: str | None = None,
    status_class: int | None = None,
    cache_status: str | None = None,
) -> DataFrame:
    """The dashboard's saved filters: agent prefix, one client, status class, cache state."""
    if agent_prefix is not None:
        requests = requests.where(F.col("user_agent").startswith(agent_prefix))
    if client is not None:
        requests = requests.where(F.col("logical_client_id") == client)
    if status_class is not None:
        requests = requests.where(F.col("status").between(status_class * 100, status_class * 100 + 99))
    if cache_status is not None:
        requests = requests.where(F.col("cache_status") == cache_status)
    return requests


def log_search(requests: DataFrame, text: str = "", status: str = "all") -> DataFrame:
    """Substring in address, path or agent, and a status filter: all, blocked, allowed or a code."""
    if text:
        hit = F.lit(False)
        for name in ("remote_addr", "client_ip", "content_path", "user_agent"):
            hit = hit | F.col(name).contains(text)
        requests = requests.where(hit)
    if status == "blocked":
        return requests.where("blocked")
    if status == "allowed":
        return requests.where("NOT blocked")
    return requests if status == "all" else requests.where(F.col("status") == int(status))


# --- pipeline and gateway metrics ----------------------------------------------------------


def order_statistics(counted: DataFrame, key: str, value: str, shares: list[float]) -> DataFrame:
    """Exact percentiles (with linear interpolation) of counted values per key: key, share, percentile.

    ``counted`` has one row per (key, value) with its count ``n``; values are whole numbers.  A first
    pass counts buckets as wide as the square root of the key's range and finds the buckets that hold
    the wanted ranks, a second one orders the values of those buckets alone.  No task holds more than
    about the square root of a key's range, however many rows or distinct values the key has.
    """
    span = counted.groupBy(key).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.sum("n").alias("_rows"))
    width = F.ceil(F.sqrt(F.col("_high") - F.col("_low") + 1)).cast("bigint")
    span = span.select(key, "_low", "_rows", width.alias("_width"))
    rank = F.col("share") * (F.col("_rows") - 1)
    wanted = span.select(key, "_rows", F.explode(F.array(*[F.lit(p) for p in shares])).alias("share"))
    ends = F.array(F.struct(F.lit("low").alias("end"), F.floor(rank).alias("rank")), F.struct(F.lit("high").alias("end"), F.ceil(rank).alias("rank")))
    wanted = wanted.select(key, "share", (rank - F.floor(rank)).alias("part"), F.inline(ends))

    def placed(rows: DataFrame, group: list[str], order: str) -> DataFrame:
        """The rows of a group before each one, in order."""
        before = F.sum("n").over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
        return rows.withColumn("_before", F.coalesce(before, F.lit(0)))

    bucketed = counted.join(span.select(key, "_low", "_width"), key).withColumn("_bucket", F.expr(f"({value} - _low) div _width"))
    coarse = placed(bucketed.groupBy(key, "_bucket").agg(F.sum("n").alias("n")), [key], "_bucket")
    holds = (F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("n"))
    chosen = wanted.join(coarse, key).where(holds).select(key, "share", "part", "end", "_bucket", (F.col("rank") - F.col("_before")).alias("rank"))
    fine = bucketed.join(chosen.select(key, "_bucket").distinct(), [key, "_bucket"], "left_semi").select(key, "_bucket", value, "n")
    found = chosen.join(placed(fine, [key, "_bucket"], value), [key, "_bucket"]).where(holds)
    low, high = (F.max(F.when(F.col("end") == e, F.col(value))) for e in ("low", "high"))
    return found.groupBy(key, "share").agg((low + (high - low) * F.max("part")).alias("percentile"))


DELAYS = {0.5: "delay_p50_ms", 0.95: "delay_p95_ms", 0.99: "delay_p99_ms"}


def window_metrics(requests: DataFrame, bucket: str = "1 hour") -> DataFrame:
    """Per window: requests, MB and errors per second, cache hits, and delay percentiles.

    The delay is from the record's own time to its ingest time in whole milliseconds.  Rows
    are first counted per (window, delay) and written; sums and exact percentiles read the counts.
    """
    delay = F.unix_millis("ingest_ts") - F.unix_millis("event_ts")
    window = F.window("event_ts", bucket)
    counted = (
        requests.select(window.alias("w"), delay.alias("delay_ms"), "size", "status", "cache_status")
        .select(F.col("w.start").alias("window_start"), (F.unix_seconds("w.end") - F.unix_seconds("w.start")).alias("length"), "*")
        .groupBy("window_start", "length", "delay_ms")
        .agg(
            F.count("*").alias("n"),
            F.sum("size").alias("bytes"),
            F.count_if(F.col("status") >= 400).alias("errors"),
            F.count_if(F.col("cache_status") == "HIT").alias("hits"),
            F.count_if(F.col("cache_status").isin("HIT", "MISS")).alias("cacheable"),
        )
    )
    counted = materialize(counted, "window-delays")
    sums = counted.groupBy("window_start", "length").agg(
        F.sum("n").alias("requests"), *[F.sum(c).alias(c) for c in ("bytes", "errors", "hits", "cacheable")], F.max("delay_ms").alias("lag_ms")
    )
    known = counted.where("delay_ms IS NOT NULL").select("window_start", "delay_ms", "n")
    found = order_statistics(known, "window_start", "delay_ms", list(DELAYS))
    delays = found.groupBy("window_start").agg(*[F.round(F.max(F.when(F.col("share") == p, F.col("percentile"))), 3).alias(n) for p, n in DELAYS.items()])
    return sums.join(delays, "window_start", "left").select(
        "window_start",
        "requests",
        F.round(F.col("requests") / F.col("length"), 6).alias("requests_per_sec"),
        F.round(F.col("bytes") / 1e6 / F.col("length"), 6).alias("mb_per_sec"),
        F.round(F.col("errors") / F.col("requests"), 6).alias("error_rate"),
        F.round(F.try_divide("hits", "cacheable"), 6).alias("cache_hit_ratio"),
        *DELAYS.values(),
        "lag_ms",
    )


def rate_limit_report(requests: DataFrame, per_address: int = 100, per_token: int = 50) -> DataFrame:
    """Seconds in which an address or a token exceeds its request limit."""
    second = F.date_trunc("second", "event_ts").alias("second")
    items = F.array(
        F.struct(F.lit("address").alias("kind"), F.col("client_ip").alias("value")),
        F.struct(F.lit("token").alias("kind"), F.col("session_token").alias("value")),
    )
    counts = (
        requests.select(second, F.inline(items))
        .where("value <> '-' AND value <> ''")
        .groupBy("second", "kind", "value")
        .agg(F.count("*").alias("requests"))
    )
    limit = F.when(F.col("kind") == "address", per_address).otherwise(per_token)
    return counts.where(F.col("requests") > limit)


# --- scenario features ---------------------------------------------------------------------

SCENARIO_INPUTS = ("client_ip", "cdn_token_id", "request_kind", "content_id", "segment")


def token_features(rows: DataFrame) -> DataFrame:
    """Per token: clients, segment requests, distinct segments, range and coverage of the range."""
    rows = rows.where("cdn_token_id <> ''")
    clients = F.struct(F.lit("c").alias("kind"), F.col("client_ip").alias("value"), F.lit(None).cast("bigint").alias("number"))
    segments = F.struct(
        F.lit("s").alias("kind"),
        F.expr("segment.segment_id").alias("value"),
        F.expr("segment.number").alias("number"),
    )
    items = rows.select("cdn_token_id", F.inline(F.array(clients, segments))).where("value IS NOT NULL")
    distinct = items.groupBy("cdn_token_id", "kind", "value").agg(F.max("number").alias("number"), F.count("*").alias("n"))
    is_segment = F.col("kind") == "s"
    out = distinct.groupBy("cdn_token_id").agg(
        F.count_if((F.col("kind") == "c") & (F.col("value") != "-")).alias("clients"),
        F.sum(F.when(is_segment, F.col("n")).otherwise(0)).alias("segment_requests"),
        F.count_if(is_segment).alias("segments"),
        F.min("number").alias("first_number"),
        F.max("number").alias("last_number"),
    )
    span = F.col("last_number") - F.col("first_number") + 1
    return out.withColumn("coverage", F.round(F.col("segments") / span, 6))


def client_features(rows: DataFrame) -> DataFrame:
    """Per client: distinct tokens, contents and playback starts."""
    items = F.array(
        F.struct(F.lit("t").alias("kind"), F.expr("if(cdn_token_id = '', NULL, cdn_token_id)").alias("value")),
        F.struct(F.lit("c").alias("kind"), F.expr("if(content_id = '', NULL, content_id)").alias("value")),
    )
    starts = F.col("request_kind") == "playback_start"
    distinct = (
        rows.select("client_ip", starts.cast("bigint").alias("starts"), F.inline(items))
        .groupBy("client_ip", "kind", "value")
        .agg(F.sum("starts").alias("starts"))
    )
    return distinct.groupBy("client_ip").agg(
        F.count_if((F.col("kind") == "t") & F.col("value").isNotNull()).alias("tokens"),
        F.count_if((F.col("kind") == "c") & F.col("value").isNotNull()).alias("contents"),
        F.sum(F.when(F.col("kind") == "t", F.col("starts")).otherwise(0)).alias("playback_starts"),
    )


def live_edge_lag(rows: DataFrame, bucket: str = "minute") -> DataFrame:
    """Per token and live content: how far requests lie behind the newest segment seen so far.

    The newest segment is taken per time bucket.  Both the edge and the requests are reduced
    per bucket before they meet, so the running maximum orders buckets, not requests.
    """
    number = F.expr("segment.number")
    live = rows.where("segment IS NOT NULL AND content_id LIKE 'live\\_%' AND cdn_token_id <> ''").select(
        "content_id", F.date_trunc(bucket, "fold_ts").alias("at"), "cdn_token_id", number.alias("number")
    ).where("number IS NOT NULL")
    per_bucket = live.groupBy("content_id", "at", "cdn_token_id").agg(
        F.count("*").alias("n"), F.sum("number").alias("total"), F.min("number").alias("low"), F.max("number").alias("top")
    )
    tops = per_bucket.groupBy("content_id", "at").agg(F.max("top").alias("top"))
    running = Window.partitionBy("content_id").orderBy("at")
    edge = tops.select("content_id", "at", F.max("top").over(running).alias("edge"))
    joined = per_bucket.join(edge, ["content_id", "at"])
    return joined.groupBy("cdn_token_id", "content_id").agg(
        F.sum("n").alias("requests"),
        F.round(F.sum(F.col("edge") * F.col("n") - F.col("total")) / F.sum("n"), 6).alias("mean_lag"),
        F.max(F.col("edge") - F.col("low")).alias("max_lag"),
    )
