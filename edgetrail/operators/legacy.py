"""The older address/token/referer graph over the last hours of the raw log, and its queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import filled, known
from .reports import time_range

# Fixed value: the country given to every address.
COUNTRY = "KR"


def recent_slice(requests: DataFrame, as_of: datetime, hours: float = 1.0, limit: int | None = None) -> DataFrame:
    """All rows of the last hours, or with ``limit`` one page of the newest."""
    recent = time_range(requests, "fold_ts", as_of, hours)
    return recent if limit is None else recent.orderBy(F.desc("fold_ts"), F.desc("arrival")).limit(limit)


def _page_rows(page: DataFrame) -> DataFrame:
    order = F.struct((-F.unix_micros("fold_ts")).alias("t"), (-F.col("arrival")).alias("a"))
    domain = F.substring_index(F.substring_index("referer", "//", -1), "/", 1)
    after = F.get(F.split("content_path", "/hls/"), 1)
    return page.select(
        F.coalesce(known(F.col("remote_addr")), F.lit("unknown")).alias("address"),
        filled(F.col("http_x_session_token")).alias("token"),
        F.when(F.col("referer") != "", domain).alias("domain"),
        filled(F.substring_index(after, ".", 1)).alias("content"),
        F.col("fold_ts").alias("at"),
        order.alias("nth"),
    )


def legacy_graph(page: DataFrame) -> dict[str, DataFrame]:
    """Node and edge tables of a slice.

    The slice is folded newest first, so "first" is the newest time; "last" is set from the
    second match on.
    """
    rows = _page_rows(page)
    first = F.min(F.struct("nth", "at"))["at"]
    last = F.when(F.count("*") > 1, F.max(F.struct("nth", "at"))["at"])

    def pairs(src: str, dst: str) -> DataFrame:
        return rows.where(f"{src} IS NOT NULL AND {dst} IS NOT NULL").groupBy(F.col(src).alias("src"), F.col(dst).alias("dst"))

    with_token = rows.where("token IS NOT NULL")
    return {
        "IPAddress": rows.groupBy("address").agg(
            first.alias("first_seen"), last.alias("last_seen"), F.lit(COUNTRY).alias("country")
        ),
        "Token": with_token.groupBy(F.col("token").alias("value")).agg(first.alias("created_at")),
        "Referer": rows.where("domain IS NOT NULL").select("domain", F.lit(True).alias("is_whitelist")).distinct(),
        "Content": with_token.where("content IS NOT NULL").select(
            F.col("content").alias("id"), F.col("content").alias("title")
        ).distinct(),
        "USED_TOKEN": pairs("address", "token").agg(first.alias("first_used"), last.alias("last_used")),
        "FROM_REFERER": pairs("address", "domain").agg(F.lit(1).alias("_")).drop("_"),
        "ACCESSED": pairs("token", "content").agg(
            first.alias("first_access"), last.alias("last_access"), F.count("*").alias("access_count")
        ),
    }


# --- queries over graph rows ---------------------------------------------------------------


def token_ip_count(rows: DataFrame, threshold: int = 5) -> DataFrame:
    """Tokens used by more than ``threshold`` addresses."""
    pairs = rows.where("cdn_token_id <> '' AND client_ip <> '-'").select("cdn_token_id", "client_ip").distinct()
    counts = pairs.groupBy("cdn_token_id").agg(F.count("*").alias("ip_count"))
    return counts.where(F.col("ip_count") > threshold)


def bad_referrer_report(rows: DataFrame) -> DataFrame:
    """Per foreign referrer: addresses that reached contents, and address-content pairs."""
    known = rows.where("client_ip <> '-' AND client_ip <> ''")
    contents = (
        known.where("content_id <> ''").select("client_ip", "content_id").distinct()
        .groupBy("client_ip").agg(F.count("*").alias("contents"))
    )
    sources = known.where("NOT referrer_legitimate").select("referrer_domain", "client_ip").distinct()
    return sources.join(contents, "client_ip").groupBy("referrer_domain").agg(
        F.count("*").alias("unique_ips"), F.sum("contents").alias("request_count")
    )


def ip_behaviour(rows: DataFrame, ip: str) -> DataFrame:
    """What one address is linked to: distinct targets per type and relationship."""
    targets = [
        ("Token", "USED_TOKEN", "if(cdn_token_id = '', NULL, cdn_token_id)"),
        ("Referer", "FROM_REFERER", "referrer_domain"),
        ("Content", "ACCESSED", "if(content_id = '', NULL, content_id)"),
    ]
    items = [
        F.struct(F.lit(t).alias("target_type"), F.lit(r).alias("relationship"), F.expr(e).alias("target"))
        for t, r, e in targets
    ]
    mine = rows.where(F.col("client_ip") == ip).select(F.inline(F.array(*items))).where("target IS NOT NULL")
    return mine.distinct().groupBy("target_type", "relationship").agg(F.count("*").alias("count"))


def asn_distribution(rows: DataFrame, networks: DataFrame) -> DataFrame:
    """Per token the number of addresses of each network type, as one sorted list.

    ``networks`` gives (ip_address, asn_type); the list has one entry per type.
    """
    pairs = rows.where("cdn_token_id <> '' AND client_ip <> '-'").select(
        "cdn_token_id", F.col("client_ip").alias("ip_address")
    ).distinct()
    typed = pairs.join(networks, "ip_address", "left")
    counts = typed.groupBy("cdn_token_id", "asn_type").agg(F.count("*").alias("count"))
    return counts.groupBy("cdn_token_id").agg(
        F.sort_array(F.collect_list(F.struct("asn_type", "count"))).alias("asn_distribution")
    )
