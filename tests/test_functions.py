"""Hand-made rows for the branches of the scalar functions."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from edgetrail import functions as fn


@pytest.fixture()
def value(spark):
    def run(make, *args):
        names = [f"c{i}" for i in range(len(args))]
        row = spark.range(1).select(*[F.lit(a).alias(n) for a, n in zip(args, names, strict=True)])
        out = row.select(make(*[F.col(n) for n in names]).alias("v")).first()["v"]
        return out.asDict() if hasattr(out, "asDict") else out

    return run


@pytest.mark.parametrize(
    ("url", "domain"),
    [
        ("https://Host.example:8443/a?b#c", "Host.example:8443"), ("host/x", "host"), ("httpbin.org", None),
        ("-", None), ("", None), ("http://[::1]/x", "[::1]"), ("ftp.example.com/x", "ftp.example.com"),
    ],
)
def test_url_domain(value, url, domain):
    assert value(fn.url_domain, url) == domain


@pytest.mark.parametrize(
    ("path", "name", "title", "plain"),
    [
        ("/hls/funny/episode1.m3u8?x=/y", "episode1.m3u8", "funny", "/hls/funny/episode1.m3u8"),
        ("/a/", None, "unknown", "/a/"), ("-", None, "unknown", ""), ("a.txt", "a.txt", "unknown", "a.txt"),
        ("//a//b", "b", "", "//a//b"),
    ],
)
def test_path_parts(value, path, name, title, plain):
    assert value(fn.path_filename, path) == name
    assert value(fn.path_title, path) == title
    assert value(fn.strip_query, path) == plain


@pytest.mark.parametrize(
    ("url", "kind"),
    [
        ("/a/INDEX.M3U8", ("video", "video")), ("/x/", ("html", "web_resource")), ("/s.CSS", ("css", "web_resource")),
        ("/a.js", ("js", "web_resource")), ("/a.json", ("api", "api")), ("/api/x", ("api", "api")),
        ("/p.WEBP", ("image", "static")), ("/plain", ("other", "other")), ("-", ("other", "other")),
    ],
)
def test_resource_type(value, url, kind):
    got = value(fn.resource_type, url)
    assert (got["type"], got["category"]) == kind


@pytest.mark.parametrize(
    ("path", "method", "kind"),
    [
        ("/hls/a/master.m3u8?t=1", "GET", "hls_manifest"), ("/hls/a/1.ts", "GET", "hls_segment"), ("/hls/a/1.mp4", "GET", None),
        ("/api/playback/start?x=1", " post ", "playback_start"), ("/api/playback/start", "GET", None),
        ("/api/browse/content/7", "get", "browse_content"), ("/api/browse/content/7", "POST", None), ("-", "GET", None),
    ],
)
def test_request_kind(value, path, method, kind):
    assert value(fn.request_kind, path, method) == kind


@pytest.mark.parametrize(
    ("referer", "content"),
    [
        ("https://h/watch/video%2001+x?y", "video 01+x"), ("h/watch/a/b", "a"), ("https://h/other/a", ""), ("-", ""),
        ("https://h/watch", ""), ("http://h//watch//a;p", "a"),
    ],
)
def test_watch_content_id(value, referer, content):
    assert value(fn.watch_content_id, referer) == content


def test_content_id_chain(value):
    def chain(q, kind, path, referer, token):
        return fn.request_content_id(q, fn.path_content_id(kind, path, referer), token)

    assert value(chain, " q ", "browse_content", "/api/browse/content/p", "-", "t") == "q"
    assert value(chain, "", "browse_content", "/api/browse/content//p%2Bq/r", "-", "t") == "p+q"
    assert value(chain, "", "hls_segment", "/hls//v//s.ts", "-", "t") == "v"
    assert value(chain, "", "playback_start", "/api/playback/start", "https://x/watch/w", "t") == "w"
    assert value(chain, "", "playback_start", "/api/playback/start", "-", "t") == "t"
    assert value(chain, "", "playback_start", "/api/playback/start", "-", "-") == ""


@pytest.mark.parametrize(
    ("referer", "answer"),
    [
        ("", ("empty", "empty", False)), (" - ", ("empty", "empty", False)),
        ("Moz-Extension://x", ("browser_extension", "extension", False)), ("httpbin.org", ("malformed", "malformed", False)),
        ("https://WWW.MyOTT.com:3000/x", ("www.myott.com:3000", "legitimate", True)),
        ("http://192.168.0.5/x", ("192.168.0.5", "legitimate", True)), ("http://localhost.evil.com/", ("localhost.evil.com", "foreign", False)),
        ("http://cdn.myott-fan.net/", ("cdn.myott-fan.net", "legitimate", True)), ("http://x.com:80/myott", ("x.com:80", "foreign", False)),
    ],
)
def test_referrer(value, referer, answer):
    got = value(fn.referrer, referer)
    assert (got["domain"], got["category"], got["is_legitimate"]) == answer


def test_ids(value):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert value(fn.token_id, "abc") == "cdn_" + sha("abc")[:24]
    assert value(fn.token_id, "-") == ""
    assert value(fn.safe_id, " a b/가.x-_ ") == "a_b_가.x-_"
    assert value(fn.safe_id, "-") == "unknown"
    assert value(fn.safe_id, "x" * 200) == "x" * 160
    assert value(fn.request_id, "-", "t", "c", "i", "p") == "req_" + sha("t|c|i|p")[:24]
    assert value(fn.session_id, "run 1", "s", "cdn_x", "a", "c", "r") == "vs_run_1"
    assert value(fn.session_id, "-", "s", "cdn_x", "a", "c", "r") == "vs_cdn_x"
    assert value(fn.session_id, "-", "-", "", "a", "c", "r") == "vs_" + sha("a|c")[:24]
    assert value(fn.session_id, "", "-", "", "-", "", "req_1") == "vs_req_1"
    assert value(fn.device_id, "-", " ua ") == "device_" + sha("ua")[:16]
    assert value(fn.device_id, "-", "-") == "device_unknown"
    assert value(fn.device_id, "d", "ua") == "d"


def test_small_choices(value):
    for agent, kind in [("", "unknown"), ("Python-x", "script"), ("Tizen Mobile", "tv"), ("iPhone Safari", "mobile"), ("Edge", "browser"), ("x", "other")]:
        assert value(fn.device_class, agent) == kind
    assert value(fn.content_type, "LIVE_1", "/x") == "live"
    assert value(fn.content_type, "v", "/HLS/live_1/a.ts") == "live"
    assert value(fn.content_type, "v", "/hls/v/a.ts") == "vod"
    for label, dataset, out in [("-", "d", "d"), ("", "-", "normal"), ("l", "d", "l"), ("-", "-", "normal")]:
        assert value(fn.resolve_label, label, dataset) == out
    assert value(fn.region_from_edge, "X-KR") == "KR"
    assert value(fn.region_from_edge, "x") == "UNKNOWN"
    for ip, region in [("::ffff:192.168.0.11, 1.1.1.1", "KR"), ("192.168.0.20", "UNKNOWN"), ("192.168.40.9", "US"), ("192.168.0.311", "UNKNOWN")]:
        assert value(fn.region_from_ip, ip) == region


def test_segment_parts(value):
    got = value(fn.segment_parts, "/hls/v%201/1080p/seg_00012.ts?x")
    assert got == {"content_id": "v 1", "filename": "seg_00012.ts", "resolution": "1080p", "number": 12, "segment_id": "v 1_1080p_seg_00012.ts"}
    got = value(fn.segment_parts, "/hls/v/x/a.ts")
    assert (got["resolution"], got["number"], got["segment_id"]) == (None, None, "v_a.ts")
    assert value(fn.segment_parts, "/hls/a.ts") is None


def test_text(value):
    assert value(lambda c: fn.sanitize_tag(c, 4, "upper"), " a-b c!d ") == "A-BC"
    assert value(lambda c: fn.sanitize_tag(c), None) == ""
    assert value(fn.split_list, " a, ,b ") == ["a", "b"]
    assert value(lambda c: fn.split_list(c, ["z"]), " ") == ["z"]
    assert value(fn.slugify, "  Été 한글 - X!! ") == "t_한글_x"
    assert [value(fn.duration_label, s) for s in (0, 59, 60, 3600, 3725)] == ["1초", "59초", "1분 0초", "1시간 0분 0초", "1시간 2분 5초"]
    assert value(lambda c: fn.resolutions(fn.split_list(c)), "720p,1080p") == ["1080p", "720p"]
    assert value(lambda c: fn.resolutions(fn.split_list(c)), "x") == ["1080p", "720p"]
    assert [value(fn.display_name, n) for n in ("a%20b+c", "%zz", "-")] == ["a b+c", "%zz", "-"]
    assert [value(fn.parse_flag, n) for n in (" ON ", "0", "")] == [True, False, False]
    assert [value(fn.parse_positive_int, n) for n in ("12px", "0", "-3", "x")] == [12, None, None, None]
    assert [value(fn.hls_path_of, n) for n in ("/hls/p/a.ts?x", "http://h/hls/q", "/x/hls", "/a")] == ["p", "q", "", ""]
    body, query = {"deviceId": "b!"}, {"device_id": " ", "deviceId": "q"}
    maps = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    assert value(lambda _: fn.first_tag(maps(body), maps(query), ["device_id", "deviceId"]), 1) == "b"


def test_numbers(value):
    assert [value(fn.to_long, t) for t in ("12", "12.7", "-", None)] == [12, 0, 0, 0]
    assert [value(fn.to_double, t) for t in ("0.5", "0.1, 0.2", "-")] == [0.5, 0.0, 0.0]
