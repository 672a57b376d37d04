"""Playlists in a folder tree, relational tables, sinks and exports."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from edgetrail.functions.identity import region_from_ip
from edgetrail.functions.values import to_double
from edgetrail.operators import playlists as pl
from edgetrail.operators.edge_choice import edge_for
from edgetrail.operators.graph_rows import graph_rows
from edgetrail.operators.normalize import normalize_requests
from edgetrail.schemas import TABLES
from edgetrail.sources import logs as logs_source
from edgetrail.sources import relational, sinks
from edgetrail.sources.logs import read_api_events, read_origin_log
from edgetrail.sources.playlists import list_files, read_playlists
from test_folds import records

MASTER = '#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=1,CODECS="a,b"\n720p/playlist.m3u8\n#EXT-X-STREAM-INF:BANDWIDTH=2\n1080p/playlist.m3u8\n'


def media(folder, sequence=10, end=True, segments=("a.ts", "b.ts")):
    folder.mkdir(parents=True)
    body = f"#EXTM3U\n#EXT-X-TARGETDURATION:2\n#EXT-X-MEDIA-SEQUENCE:{sequence}\n" + "".join(f"#EXTINF:2,\n{s}\n" for s in segments)
    (folder / "playlist.m3u8").write_text(body + ("#EXT-X-ENDLIST\n" if end else ""))
    for s in segments:
        (folder / s).write_bytes(b"x")


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "hls tree"
    for name, end in (("video 01", True), ("live_01", False)):
        for r in ("720p", "1080p"):
            media(root / name / r, end=end)
        (root / name / "master.m3u8").write_text(MASTER)
    return root


def test_inventory_of_a_tree(spark, tree):
    items = pl.inventory(read_playlists(spark, str(tree)), list_files(spark, str(tree)))
    got = {r["content_id"]: r for r in items.collect()}
    assert {k: (v["content_type"], v["playlists"], v["missing_renditions"], v["errors"]) for k, v in got.items()} == {
        "video 01": ("vod", 2, "", 0), "live_01": ("live", 2, "", 0)}
    summary = pl.inventory_summary(items).first()
    assert (summary["contents"], summary["vod"], summary["live"], summary["passed"]) == (2, 1, 1, True)


def test_missing_variant_and_segment(spark, tree):
    (tree / "video 01" / "1080p" / "playlist.m3u8").unlink()
    (tree / "live_01" / "720p" / "b.ts").unlink()
    errors = pl.reference_errors(read_playlists(spark, str(tree)), list_files(spark, str(tree)))
    assert {tuple(r) for r in errors.collect()} == {
        ("video 01", "missing master variant: 1080p/playlist.m3u8"),
        ("live_01", "missing referenced last_segment: live_01/720p/b.ts")}


def test_variant_attributes(spark, tree):
    rows = pl.variants(read_playlists(spark, str(tree))).where("content_id = 'live_01'").collect()
    assert sorted((r["uri"], r["attributes"].get("CODECS")) for r in rows) == [("1080p/playlist.m3u8", None), ("720p/playlist.m3u8", "a,b")]


def test_live_advance(spark):
    schema = "key string, media_sequence bigint, last_segment string"
    before = spark.createDataFrame([("a", 10, "x"), ("b", 10, "x"), ("c", 10, "x"), ("d", None, "x")], schema)
    after = spark.createDataFrame([("a", 11, "x"), ("b", 10, "x"), ("d", None, "y")], schema)
    checked = pl.live_advance(before, after)
    assert {r["key"]: r["advanced"] for r in checked.collect()} == {"a": True, "b": False, "c": False, "d": True}
    items = spark.createDataFrame([("a", "live"), ("b", "live"), ("v", "vod")], "content_id string, content_type string")
    assert tuple(pl.live_advance_summary(checked, items).first()) == (2, 4, 2, False)
    moved = checked.where("advanced")
    assert tuple(pl.live_advance_summary(moved, items, 2).first()) == (2, 2, 0, True)
    assert tuple(pl.live_advance_summary(moved, items, 3).first()) == (2, 2, 0, False)
    assert tuple(pl.live_advance_summary(moved.limit(0), items.limit(0), 0).first()) == (0, 0, 0, False)


def test_live_playlists_are_those_of_live_contents(spark):
    media = spark.createDataFrame([("a", "720p/p.m3u8"), ("v", "720p/p.m3u8"), (None, "x")], "content_id string, path string")
    items = spark.createDataFrame([("a", "live"), ("v", "vod")], "content_id string, content_type string")
    assert [r["key"] for r in pl.live_playlists(media, items).collect()] == ["a/720p/p.m3u8"]


def test_graph_sink(spark, logs, tmp_path):
    rows = graph_rows(logs(*records(60, 8)))
    counts = sinks.sink_graph(rows, str(tmp_path / "g"))
    again = sinks.sink_graph(rows, str(tmp_path / "g"))
    assert counts == again and counts["ViewingSession"] > 0 and counts["MAKES_REQUEST"] >= counts["Request"]


def test_partitioned_sink_and_exports(spark, logs, tmp_path):
    requests = normalize_requests(logs(*[{**r, "service": f"s{i % 2}"} for i, r in enumerate(records(30, 9))]), ["service", "status", "query_params"])
    sinks.sink_partitioned(requests.drop("query_params"), str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.count() == 30 and back.select("service", "date").distinct().count() == 2
    sinks.export_csv(requests, str(tmp_path / "c"))
    sinks.export_json(requests, str(tmp_path / "j"))
    assert spark.read.csv(str(tmp_path / "c"), header=True, multiLine=True).count() == 30
    assert spark.read.json(str(tmp_path / "j")).count() == 30


def test_typed_readers(spark, tmp_path):
    (tmp_path / "api.json").write_text(json.dumps({"@timestamp": "2024-01-01T00:00:00.5Z", "status": 200, "token_valid": True, "event_kind": "browse_content"}) + "\n")
    row = read_api_events(spark, str(tmp_path / "api.json")).first()
    assert row["status"] == 200 and row["token_valid"] is True and row["client_ip"] is None
    (tmp_path / "origin.json").write_text(json.dumps({"remote_addr": "1.1.1.1", "status": "200", "request_time": "0.1"}) + "\n")
    assert read_origin_log(spark, str(tmp_path / "origin.json")).first()["request_time"] == "0.1"
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))
    assert set(relational.read_catalog_tables(spark, str(tmp_path))) == set(TABLES)


def test_overlapping_patterns_read_a_file_once(spark, tmp_path):
    (tmp_path / "a one.log").write_text('{"timestamp":"2024-01-01T00:00:00Z"}\n')
    assert logs_source.read_index(spark, [f"{tmp_path}/*.log", f"{tmp_path}/a*.log"]).count() == 1


def test_envelope_takes_objects_and_trims_messages(spark):
    raws = ['{"message":"  {\\"status\\":\\"200\\"} "}', '{"json":"{\\"status\\":\\"200\\"}"}', '{"json" : {"status":"200"}}']
    rows = spark.createDataFrame([(r,) for r in raws], "raw string")
    assert [json.loads(r.raw).get("status") for r in logs_source.merge_envelope(rows, "raw").collect()] == ["200", None, "200"]


def test_several_edges_of_a_region_give_one_row(spark):
    requests = spark.createDataFrame([("", "10.0.0.1"), ("EDGE-b", "10.0.0.1")], "edge_id string, client_ip string")
    region = requests.select(region_from_ip(F.col("client_ip"))).first()[0]
    edges = spark.createDataFrame([("edge-b", region, "u2"), ("edge-a", region, "u1")], "edge_id string, region string, url string")
    chosen = edge_for(requests, edges, "none", "none").orderBy("edge_id").collect()
    assert len(chosen) == 2 and chosen[1].chosen_edge == "edge-b" and chosen[0].chosen_edge in ("edge-a", "none")


def test_type_letters_are_no_numbers(spark):
    rows = spark.createDataFrame([("5d",), ("5f",), ("5.5",), ("1e3",), (None,)], "v string")
    assert [r[0] for r in rows.select(to_double(F.col("v"))).collect()] == [0.0, 0.0, 5.5, 1000.0, 0.0]
