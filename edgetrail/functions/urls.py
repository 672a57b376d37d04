"""URL and path functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import filled, is_known

# File-name marks of each resource type, tested in this order.
VIDEO_MARKS = [".mp4", ".m3u8", ".ts", ".webm", ".mkv"]
IMAGE_MARKS = [".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg"]

# Path prefixes of the delivery API.
HLS_PREFIX = "/hls/"
BROWSE_PREFIX = "/api/browse/content/"
PLAYBACK_START = "/api/playback/start"

# Hosts that count as the service's own pages.
OWN_HOSTS = ["localhost", "127.0.0.1", "ott.local", "myott.com", "www.myott.com"]
OWN_HOST_PREFIXES = ["192.168.", "10.", "172."]
OWN_HOST_MARK = "myott"

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_STRAY_PERCENT = r"%(?![0-9A-Fa-f]{2})"


def percent_decode(col: Column) -> Column:
    """Decode ``%xx`` only; ``+`` and broken escapes stay as they are."""
    guarded = F.replace(F.regexp_replace(col, _STRAY_PERCENT, "%25"), F.lit("+"), F.lit("%2B"))
    return F.when(col.contains("%"), F.url_decode(guarded)).otherwise(col)


def form_decode(col: Column) -> Column:
    """Decode ``%xx`` and ``+`` as in a query string; broken escapes stay."""
    guarded = F.regexp_replace(col, _STRAY_PERCENT, "%25")
    return F.when(col.rlike("[%+]"), F.url_decode(guarded)).otherwise(col)


def display_name(col: Column) -> Column:
    """Percent-decoded text, the raw text if an escape is broken, ``-`` if absent."""
    guarded = F.replace(col, F.lit("+"), F.lit("%2B"))
    return F.when(is_known(col), F.coalesce(F.try_url_decode(guarded), col)).otherwise("-")


def _with_scheme(url: Column) -> Column:
    return F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("http://"), url))


def url_domain(url: Column) -> Column:
    """Authority with port, NULL if there is none.

    The usual forms are cut with plain substrings; only odd schemes need the pattern.
    """
    rest = (
        F.when(url.startswith("https://"), F.substr(url, F.lit(9)))
        .when(url.startswith("http://"), F.substr(url, F.lit(8)))
        .when(~url.startswith("http"), url)
        .otherwise(F.regexp_extract(url, _AUTHORITY, 1))
    )
    for mark in "/?#":
        rest = F.substring_index(rest, mark, 1)
    return F.when(is_known(url), filled(rest))


def strip_query(path: Column) -> Column:
    return F.when(is_known(path), F.substring_index(path, "?", 1)).otherwise("")


def path_filename(path: Column) -> Column:
    name = F.substring_index(F.substring_index(path, "?", 1), "/", -1)
    return F.when(is_known(path), filled(name))


def path_title(path: Column) -> Column:
    """Second path component, ``unknown`` if there is none."""
    parts = F.split(F.btrim(path, F.lit("/")), "/")
    return F.when(is_known(path), F.coalesce(F.get(parts, 1), F.lit("unknown"))).otherwise("unknown")


def names_any(low: Column, marks: list[str]) -> Column:
    """Whether lower-case text contains one of the marks."""
    found = low.contains(marks[0])
    for mark in marks[1:]:
        found = found | low.contains(mark)
    return found


def resource_type(url: Column, low: Column | None = None) -> Column:
    """``struct<type, category>`` by ordered substring rules.

    ``low`` is the lower-case text where that is already a column.
    """
    low = F.lower(url) if low is None else low

    def kind(type_: str, category: str) -> Column:
        return F.struct(F.lit(type_).alias("type"), F.lit(category).alias("category"))

    return (
        F.when(~is_known(url), kind("other", "other"))
        .when(names_any(low, VIDEO_MARKS), kind("video", "video"))
        .when(url.endswith("/") | names_any(low, [".html", "index"]), kind("html", "web_resource"))
        .when(names_any(low, [".css"]), kind("css", "web_resource"))
        .when(names_any(low, [".js"]) & ~names_any(low, [".json"]), kind("js", "web_resource"))
        .when(names_any(low, ["/api/", ".json"]), kind("api", "api"))
        .when(names_any(low, IMAGE_MARKS), kind("image", "static"))
        .otherwise(kind("other", "other"))
    )


def request_kind(path: Column, method: Column) -> Column:
    """hls_manifest, hls_segment, playback_start, browse_content or NULL."""
    return kind_of_path(strip_query(path), method)


def kind_of_path(clean: Column, method: Column) -> Column:
    """``request_kind`` of a path without its query."""
    verb = F.trim(F.upper(F.coalesce(method, F.lit(""))))
    return (
        F.when(
            clean.startswith(HLS_PREFIX),
            F.when(clean.endswith(".m3u8"), "hls_manifest").when(clean.endswith(".ts"), "hls_segment"),
        )
        .when((verb == "POST") & (clean == PLAYBACK_START), "playback_start")
        .when((verb == "GET") & clean.startswith(BROWSE_PREFIX), "browse_content")
    )


def watch_content_id(referer: Column) -> Column:
    """Content id of a ``/watch/<id>`` page, ``""`` if the referer is another page."""
    path = F.regexp_replace(F.regexp_extract(_with_scheme(referer), _PATH, 1), ";[^/]*$", "")
    first = F.trim(percent_decode(F.regexp_extract(path, "^/*([^/]+)", 1)))
    second = F.trim(percent_decode(F.regexp_extract(path, "^/*[^/]+/+([^/]+)", 1)))
    return F.when(is_known(referer) & (first == "watch"), second).otherwise("")


def path_content_id(kind: Column, path: Column, referer: Column) -> Column:
    """Content that the path, or for a playback start the referer, names."""
    browse = F.btrim(F.substr(path, F.lit(len(BROWSE_PREFIX) + 1)), F.lit("/"))
    hls = F.regexp_extract(path, "^/hls/+([^/]+)", 1)
    return (
        F.when(kind == "browse_content", F.trim(percent_decode(F.substring_index(browse, "/", 1))))
        .when(kind == "playback_start", watch_content_id(referer))
        .when(kind.isin("hls_manifest", "hls_segment"), F.trim(percent_decode(hls)))
    )


def request_content_id(query_content_id: Column, named: Column, token_content_id: Column) -> Column:
    """Target content: query parameter, then ``path_content_id``, then the token's content."""
    token_content = F.when(token_content_id != "-", token_content_id)
    return F.coalesce(filled(F.trim(query_content_id)), filled(named), filled(token_content), F.lit(""))


def referrer_host(referer: Column) -> Column:
    """Lower-case authority of a Referer header."""
    return F.lower(url_domain(F.trim(referer)))


def referrer(referer: Column, domain: Column | None = None) -> Column:
    """``struct<domain, category, is_legitimate>`` of a Referer header.

    ``domain`` is its ``referrer_host`` where that is already a column.
    """
    raw = F.trim(F.coalesce(referer, F.lit("")))
    domain = referrer_host(referer) if domain is None else domain
    names = "|".join(re.escape(h) for h in OWN_HOSTS)
    prefixes = "|".join(re.escape(p) for p in OWN_HOST_PREFIXES)
    own = domain.rlike(f"^(?:(?:{names})(?::|$)|{prefixes}|[^:]*{OWN_HOST_MARK})")

    def answer(name: Column, category: Column, legitimate: Column) -> Column:
        return F.struct(name.alias("domain"), category.alias("category"), legitimate.alias("is_legitimate"))

    no = F.lit(False)
    return (
        F.when(~is_known(raw), answer(F.lit("empty"), F.lit("empty"), no))
        .when(
            raw.rlike("(?i)^(chrome|moz)-extension://"),
            answer(F.lit("browser_extension"), F.lit("extension"), no),
        )
        .when(domain.isNull(), answer(F.lit("malformed"), F.lit("malformed"), no))
        .otherwise(answer(domain, F.when(own, "legitimate").otherwise("foreign"), own))
    )


def hls_path_of(uri: Column) -> Column:
    """Component after the first ``hls`` component, ``""`` if there is none."""
    path = F.concat(F.lit("/"), F.substring_index(uri, "?", 1))
    return F.coalesce(F.regexp_extract(path, "^(?:/+(?!hls/)[^/]+)*/+hls/+([^/]+)", 1), F.lit(""))
